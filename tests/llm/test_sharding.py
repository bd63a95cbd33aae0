from collections import Counter, defaultdict

import pytest

from cloakframe.llm import sharding
from cloakframe.llm.sharding import interleave


@pytest.mark.parametrize("n", [0, 1, 5, 23, 997])
def test_law_and_mixture(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "_bits", lambda rows: 4)  # several buckets on a small table
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 11}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = interleave(df, shards=7).collect()
    assert sorted(r.doc_id for r in out) == list(range(n))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    total = Counter(r.source for r in out)
    for s in by:
        mine = Counter(r.source for r in by[s])
        # sources of one size step together, so what they bring at once displaces the largest source
        assert all(abs(mine[x] - total[x] / 7) <= (2 if x != "hot" else 1 + len(total) / 2) for x in total)


def test_positions_follow_the_fractional_ranks(spark):
    df = spark.createDataFrame([(i, str(i), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    order = [r.source for r in sorted(interleave(df, shards=1).collect(), key=lambda r: r.slot)]
    assert all({order[i], order[i + 1]} == {"a", "b"} for i in range(0, 40, 2))
    again = {r.doc_id: (r.shard, r.slot) for r in interleave(df.repartition(3), shards=5).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in interleave(df, shards=5).collect()}


def test_edges(spark, edge_docs, empty_docs):
    out = interleave(edge_docs).collect()
    assert len(out) == 12 and Counter(r.shard for r in out).most_common(1)[0][1] == 1 and out[0]._key == "x"
    assert interleave(empty_docs).count() == 0


@pytest.mark.parametrize("bits", [0, 3])
def test_order_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(sharding, "_bits", lambda rows: bits)
    rows = [(i, f"t{i % 90}", None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(7, "t7", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = df.selectExpr("*", "xxhash64(text, 20) AS tie").selectExpr("*", "shiftrightunsigned(xxhash64(20, doc_id, tie), 1) AS key", "xxhash64(source, 20) AS hs").collect()
    placed = []
    for source in {r.source for r in keyed}:
        mine = sorted((r for r in keyed if r.source == source), key=lambda r: (r.key, r.doc_id, r.tie))
        placed += [((i + 0.5) / len(mine), r.hs, r.source or "", r.key, r.doc_id, r.tie) for i, r in enumerate(mine)]
    placed.sort()
    n, shards = len(placed), 7
    want = Counter((x[4], k * shards // n, k - -(-(k * shards // n) * n // shards)) for k, x in enumerate(placed))
    assert Counter((r.doc_id, r.shard, r.slot) for r in interleave(df, shards=shards).collect()) == want
