import base64
import hashlib
import io
import random
import zlib

import pytest

from cloakframe.llm import warc
from cloakframe.llm.warc import Warc, members, parse, read_archives, write_archives


def test_any_split_reads_each_record_once():
    r = random.Random(1)
    recs = [warc.member(warc.record(i, f"http://h/{i}", r.randbytes(r.randint(0, 4000)) + warc.MAGIC * r.randint(0, 3), None, "d"), 1) for i in range(40)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored blocks keep gzip magic of whole members inside
    inner = stored.compress(warc.record(40, None, recs[0] + recs[1], None, "d")) + stored.flush()
    data = b"junk" + b"".join(recs) + inner
    for size in (64, 997, 5000, 1 << 20):
        got = [parse(x)[1] for s in range(0, len(data), size) for x in members(io.BytesIO(data), s, min(s + size, len(data))) if x is not None]
        assert [g for g in got if g != 40][:40] == list(range(40))
    cut = [x for x in members(io.BytesIO(data[:-40]), 0, len(data))]
    assert cut[0] is None and [parse(x)[1] for x in cut[1:41]] == list(range(40)) and cut[41] is None  # the junk, and the last member that was cut


def brute(rows, least=0):
    body = [(i, u, (h or "").encode()) for i, u, h in rows]
    out = []
    for i, u, b in body:
        same = [j for j, _, c in body if c == b and j is not None]
        lead = min(same) if same and len([1 for _, _, c in body if c == b]) > 1 and len(b) >= least else i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://x/{i} é\n", f"<p>page {i % 9} é</p>" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", "<p>n</p>"), (None, "v", "<p>n</p>"), (5, "again", "<p>page 5 é</p>" * 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for p in (Warc(split_bytes=700), Warc(min_payload=20)):
        out = read_archives(write_archives(df, p), p).collect()
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
        assert got == brute(rows, p.min_payload)
    html = {r.page_id: r.payload for r in out if r.record_type == "response"}
    assert bytes(html[8]).decode() == rows[8][2]
    assert {r.url for r in out if r.page_id == 3} == {"http://x/3%20é%0A"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(df)).count() == 0


def archive(tmp_path, spark, data):
    (tmp_path / "a.warc.gz").write_bytes(data)
    return spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data))], "path string, bytes long")


def foreign(kind, ident, block, more=""):
    return warc.member(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6)


def test_archives_of_other_writers(spark, tmp_path):
    ids = [f"urn:uuid:00000000-0000-4000-8000-00000000000{i}" for i in range(5)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    data = foreign("warcinfo", ids[0], b"software: x\r\n") + foreign("request", ids[1], b"GET / HTTP/1.1\r\n\r\n") + foreign("response", ids[2], http, "WARC-Target-URI: http://h/\r\n")
    data += foreign("revisit", ids[3], b"", f"WARC-Refers-To: <{ids[2]}>\r\nWARC-Payload-Digest: sha1:ABC\r\n") + foreign("metadata", ids[4], b"k: v")
    manifest = archive(tmp_path, spark, data)
    rows = {r.record_id: r for r in read_archives(manifest, Warc(split_bytes=90), types=None).collect()}
    assert [rows[i].record_type for i in ids] == ["warcinfo", "request", "response", "revisit", "metadata"]
    assert bytes(rows[ids[2]].payload) == b"<p>x</p>" and rows[ids[2]].url == "http://h/" and rows[ids[2]].page_id is None
    assert rows[ids[3]].refers_to_id == ids[2] and rows[ids[3]].payload_digest == "ABC" and rows[ids[3]].payload_bytes is None
    assert bytes(rows[ids[4]].payload) == b"k: v"
    assert sorted(r.record_id for r in read_archives(manifest).collect()) == ids[2:4]


def test_damaged_members_are_counted(spark, tmp_path):
    r = random.Random(2)
    recs = [warc.member(warc.record(i, "http://h/", r.randbytes(3000), None, "d"), 1) for i in range(5)]
    whole = b"".join(recs)
    at = len(recs[0]) + len(recs[1]) + len(recs[2]) // 2
    manifest = archive(tmp_path, spark, whole[:at] + bytes(16) + whole[at + 16 :])
    for size in (500, 1 << 20):
        got = read_archives(manifest, Warc(split_bytes=size), types=None).collect()
        assert sorted(x.page_id for x in got if x.record_type == "response") == [0, 1, 3, 4] and sum(x.record_type == "damaged" for x in got) == 1
    with pytest.raises(Exception, match="damaged"):
        read_archives(manifest).collect()


def test_a_header_at_the_end_of_the_buffer():
    big = warc.member(warc.record(1, "u", random.Random(3).randbytes(warc.PIECE - 60), None, "d"), 0)
    data = big + warc.member(warc.record(2, "u", b"x" * 50, None, "d"), 9)
    for cut in (warc.PIECE - 100, warc.PIECE - 10, warc.PIECE):
        pad = b"\0" * cut
        got = [parse(x)[1] for x in members(io.BytesIO(pad + data), 0, len(pad) + len(data)) if x is not None]
        assert got == [1, 2]


def test_splits_are_tasks(spark):
    df = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 256), 40) AS html").coalesce(1)
    out = read_archives(write_archives(df), Warc(split_bytes=4_000))
    assert out.rdd.getNumPartitions() > 10 and out.count() == 300
