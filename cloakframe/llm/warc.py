"""WARC archives: a writer, and a splittable reader.

Every record is a gzip member of its own.  The reader cuts archives into byte ranges without an index.
A task scans its range for the gzip magic, takes a position as a member only if its first bytes inflate
to a WARC version line, and owns the records that start inside its range: it follows them member by
member, reading past the end of the range to finish the last one.  Magic bytes that happen to occur in
compressed data fail the header check and the scan goes on behind them.  So each record is read exactly
once, whatever the split size.  Splits are dealt to as many tasks as there are splits (``max_tasks`` at most).

Archives of other writers are read too: record ids are text, ``types`` says which records are returned.
What lies between members and is no member, and a member that ends early, is a record of type ``damaged``:
it is never dropped unseen, ``read_archives`` raises where it meets one unless ``types`` asks for it.

Of pages with equal payloads (of at least ``min_payload`` bytes) the one with the least page_id is
written as a response; the others are revisit records without payload that name it.

Archives go to the shared folder through the file system named by its URI.  A task attempt writes a file
of its own name and reports it; only reported files are read, so repeated attempts do no harm.

Defined results: a null html is an empty payload; a null url is written without a target; repeated rows
of the least page_id are all responses; rows with a null page_id never lead a group that has an id; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, fresh_path

MAGIC = b"\x1f\x8b\x08"
PIECE = 1 << 20


@dataclass(frozen=True)
class Warc:
    min_payload: int = 0
    level: int = 4
    split_bytes: int = 4 << 20
    max_tasks: int = 100_000
    date: str = "2024-01-01T00:00:00Z"


def with_leaders(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """(page_id, url, html, leader): leader is the response's page_id for the other copies, else null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", "html", F.unhex(F.sha1(F.encode(body, "UTF-8"))).alias("digest"), F.octet_length(body).alias("size"))
    # written before they are joined: a join on top of the grouping's exchange could not split a hot digest
    groups = cut(
        base.where(F.col("size") >= p.min_payload).groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies"),
        "leaders",
    )
    out = base.join(groups, ["digest", "size"], "left")
    leader = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return out.select("page_id", "url", "html", leader.alias("leader"))


def record(page_id: int | None, url: str | None, payload: bytes, leader: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if leader is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if leader is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if leader is not None:
        head += [f"WARC-Refers-To: <urn:page:{leader}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, p: Warc) -> Iterator[pa.RecordBatch]:
    out, uri, n, size = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
    for batch in batches:
        for page_id, url, html, leader in zip(*(batch.column(i) for i in range(4)), strict=True):
            if out is None:
                fs, path = pa.fs.FileSystem.from_uri(folder)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{uri.rpartition('/')[2]}", compression=None)  # members are compressed one by one
            data = member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), leader.as_py(), p.date), p.level)
            out.write(data)
            n, size = n + 1, size + len(data)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])


def write_archives(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """Writes the pages as archives into the shared folder; gives their manifest (path, bytes, records)."""
    folder = fresh_path(pages.sparkSession, "warc")
    return cut(with_leaders(pages, p).mapInArrow(partial(_write, folder=folder, p=p), "path string, bytes long, records long"), "manifest")


class Tail:
    """Bytes of a file from ``start`` on, fetched piece by piece."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, bytearray()
        file.seek(start)

    def upto(self, n: int) -> bool:
        """Holds ``n`` bytes if the file has them."""
        while len(self.data) < n:
            piece = self.file.read(max(PIECE, n - len(self.data)))
            if not piece:
                return False
            self.data += piece
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def inflate(self, least: int | None = None) -> tuple[bytes, int] | None:
        """The member at the front and its compressed length (None if it is no complete member); with
        ``least``, its first bytes only."""
        z, out, used, size = zlib.decompressobj(31), [], 0, 0
        try:
            while not z.eof:
                if used >= len(self.data) and not self.upto(used + 1):
                    return None
                piece = bytes(self.data[used : used + PIECE])
                out.append(z.decompress(piece, least or 0))
                used, size = used + len(piece), size + len(out[-1])
                if least and size >= least:
                    return b"".join(out), 0
        except zlib.error:
            return None
        return b"".join(out), used - len(z.unused_data)


def members(file, start: int, end: int) -> Iterator[bytes | None]:
    """The records whose members start in [start, end); None for each damaged stretch behind one."""
    tail, behind = Tail(file, start), start == 0
    while tail.at < end:
        if not tail.data and not tail.upto(1):
            return
        tail.upto(min(end - tail.at, PIECE) + len(MAGIC))
        found = tail.data.find(MAGIC)
        if found and behind:
            behind = False
            yield None
        if found < 0:
            if len(tail.data) < len(MAGIC):
                return
            tail.drop(len(tail.data) - len(MAGIC) + 1)
            continue
        tail.drop(found)
        if tail.at >= end:
            return
        head = tail.inflate(least=16)
        if not head or not head[0].startswith(b"WARC/1."):
            if behind:
                behind = False
                yield None
            tail.drop(1)
            continue
        whole = tail.inflate()
        if whole is None:
            behind = False
            yield None
            tail.drop(1)
            continue
        yield whole[0]
        behind = True
        tail.drop(whole[1])


FIELDS = [
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
]
OWN_ID = re.compile(r"urn:page:(-?[0-9]{1,19})")


def _number(ident: str | None) -> int | None:
    """The page_id in an id that our writer made."""
    m = OWN_ID.fullmatch(ident or "")
    return int(m[1]) if m else None


def parse(data: bytes | None) -> tuple:
    """A record's fields.  Lengths and digests of what has a payload are those of the payload that was read."""
    if data is None:
        return None, None, None, "damaged", None, None, None, None, None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.decode("utf-8", "replace").strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    kind = fields.get("warc-type", "").lower()
    http, _, payload = block.partition(b"\r\n\r\n")
    ident, to = (fields[k].strip("<> ") if k in fields else None for k in ("warc-record-id", "warc-refers-to"))
    size: int | None
    if kind == "revisit":
        told = re.search(rb"(?i)(?:^|\r\n)Content-Length: *(\d+)", http)
        size, digest, payload = int(told[1]) if told else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    else:
        payload = payload if kind in ("response", "request") and block.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ")) else block
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return ident, _number(ident), fields.get("warc-target-uri"), kind, _number(to), to, size, digest, payload


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _read(batches: Iterator[pa.RecordBatch], payloads: bool, types: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    fields = FIELDS if payloads else FIELDS[:-1]
    for batch in batches:
        for uri, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, path = pa.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as file:
                rows, size = [], 0
                for data in members(file, start, end):
                    row = parse(data)
                    if types is not None and row[3] not in types:
                        if row[3] == "damaged":
                            raise ValueError(f"a damaged stretch between {start} and {end} of {uri}; ask for the type 'damaged' to count such stretches")
                        continue
                    rows.append(row[: len(fields)])
                    size += len(data or b"") if payloads else 200
                    if size > 4 << 20:
                        yield _rows(rows, fields)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, fields)


def read_archives(manifest: DataFrame, p: Warc = Warc(), payloads: bool = True, types: tuple[str, ...] | None = ("response", "revisit")) -> DataFrame:
    """Records of the archives in ``manifest`` (path and bytes), read by byte ranges.  ``types`` None gives
    the records of every type, damaged stretches included."""
    cuts = F.ceil(F.col("bytes") / p.split_bytes)
    n = manifest.where("bytes > 0").agg(F.sum(cuts)).first()[0] or 1
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(p.split_bytes).cast("long")))
    splits = manifest.where("bytes > 0").select("path", "bytes", start.alias("start"))
    # a number keeps adaptive execution from merging the tiny rows into one task
    splits = splits.select("path", "start", F.least(F.col("start") + p.split_bytes, F.col("bytes")).alias("end")).repartition(int(min(n, p.max_tasks)))
    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    schema = ", ".join(f"{n} {kinds[str(t)]}" for n, t in (FIELDS if payloads else FIELDS[:-1]))
    return splits.mapInArrow(partial(_read, payloads=payloads, types=types), schema)
