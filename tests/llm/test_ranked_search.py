import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cloakframe.llm import ranked_search as ranked
from cloakframe.llm.ranked_search import Search, search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        rows = []
        for d, b in bags:
            n = sum(b.values())
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m)) for w in set(terms(text)) if w in b)
            if s > 0:
                rows.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(rows, key=lambda r: r[:2] + (r[2] or 0,))[:k])]
    return Counter(out)


def corpus(seed, n, vocabulary=300):
    r = random.Random(seed)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([1, 5, 30, 200]))) + r.choice(["", ".", ",!"])) for i in range(n)]


@pytest.mark.parametrize("options", [Search(), Search(k=3, block=4, first=3, growth=2, broadcast_rows=0)])
def test_against_brute_force(spark, options):
    docs = corpus(1, 400) + [(1000 + i, "copy of the same text w1 w2 w3") for i in range(150)] + [(7, "w5 w6"), (7, "w5 w6"), (8, None), (9, ""), (None, "w1 w2 W3"), (None, None)]
    items = [(i, t) for i, (_, t) in enumerate(corpus(2, 12))] + [(50, None), (51, "nowhere unseen"), (52, "copy same text"), (None, "w1 w2"), (0, "w1 w1 w4")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = Counter(tuple(r) for r in search(d, spark.createDataFrame(items, "item_id long, text string"), options).collect())
    want = brute(docs, items, options.k)
    assert {x: n for x, n in got.items() if x[2] is not None} == {x: n for x, n in want.items() if x[2] is not None}
    assert sum(got.values()) == sum(want.values())


def test_bounds_hold_and_prune(spark):
    """No exact score is above its bound, and most documents are never scored."""
    docs = spark.createDataFrame(corpus(3, 300, 2000), "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(corpus(4, 5, 2000))], "item_id long, text string")
    options = Search()
    (block,) = ranked._blocks(ranked._numbered(items, options), options)
    block = ranked.statistics(docs, block)
    index = ranked.sketches(docs, block.n, block.total)
    upper = {(r["query"], r.d0): r.bound for r in ranked._bounded(index, block, {int(q): 1 for q in block.queries}).collect()}
    every = docs.sparkSession.createDataFrame([(int(q),) for q in block.queries], "query long")
    wanted = index.select("d0", "d1").distinct().join(every)
    scores = {(r["query"], r.d0): r.score for r in ranked._scored(docs, wanted, block, options).collect()}
    assert scores and all(s <= upper[k] for k, s in scores.items())
    assert np.mean([upper[k] / s for k, s in scores.items()]) < 1.3


def test_terms():
    import pyarrow as pa

    texts = ["A-b c_d ÄÖ1 e\x00f", "", "日本 x", "x"]
    w = ranked.split(pa.array(texts, pa.large_string()))
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in terms(t)] and list(w.counts()) == [len(terms(t)) for t in texts]


def test_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "one naïve\u00a0ß")], "item_id long, text string")  # a no-break space is beyond ASCII, so it belongs to the term
    assert {r.doc_id for r in search(edge_docs, items).collect()} == {7, 8}
    assert search(empty_docs, items).count() == 0 and search(edge_docs, items.where("false")).count() == 0
