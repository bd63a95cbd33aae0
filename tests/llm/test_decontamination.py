import random
import re

import numpy as np

from cloakframe.llm.decontamination import Decontamination, align, clean, contaminated

from .conftest import make_words


def smith_waterman(a, b, p):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, prev[j - 1] + (p.match if x == y else -p.mismatch), prev[j] - p.gap, now[-1] - p.gap))
        best, prev = max(best, max(now)), now
    return best


def test_alignment_matches_the_plain_recurrence():
    r, p = random.Random(2), Decontamination()
    pairs = [([r.randint(2, 5) for _ in range(r.randint(1, 12))], [r.randint(2, 5) for _ in range(r.randint(1, 15))]) for _ in range(60)]
    left, right = np.zeros((60, 12), dtype=np.uint64), np.ones((60, 15), dtype=np.uint64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)], right[i, : len(b)] = a, b
    assert align(left, right, p)[0].tolist() == [smith_waterman(a, b, p) for a, b in pairs]


def test_finds_copies_and_edits_and_leaves_clean_documents(spark):
    r = random.Random(3)
    items = [(i, " ".join(make_words(1000 + i, 40, 5000)).capitalize() + ".") for i in range(12)]
    rows, want = [], set()
    for i in range(120):
        w = make_words(i, 200, 5000)
        if i % 4 == 0:
            item = items[i % 12]
            copy = item[1].upper().replace(".", "!").split()
            for _ in range((i // 4) % 7):
                copy[r.randrange(len(copy))] = f"other{i}"
            w[50:50] = copy
            want.add((i, item[0]))
        rows.append((i, " ".join(w)))
    rows += [rows[0], (300, None), (301, ""), (None, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tests = spark.createDataFrame(items + [(50, None), (51, ""), (52, "a b")], "item_id long, text string")
    got = [(x.id, x.item_id) for x in contaminated(docs, tests).collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] is not None} == want
    left = {x.doc_id for x in clean(docs, tests).collect()}
    assert left >= {301, 300} and {d for d, _ in want}.isdisjoint(left) and len(left - {None}) == 122 - len(want)


def test_the_passage_is_the_alignment(spark):
    item = make_words(5000, 40, 5000)
    w = make_words(1, 200, 5000)
    copy = [*item[:20], "inserted", *item[20:]]
    docs = spark.createDataFrame([(1, " ".join(w[:70] + copy + w[70:])), (2, " ".join(item))], "doc_id long, text string")
    got = {r.id: r for r in contaminated(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert (got[1].first_word, got[1].end_word, got[1].score) == (70, 111, 79 / 80) and (got[2].first_word, got[2].end_word, got[2].score) == (0, 40, 1.0)


def brute_pairs(docs, items, p):
    """All pairs of texts and items, aligned whole."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    return {(i, k) for i, t in docs for k, x in items if len(words(x)) >= p.shortest and smith_waterman(words(x), words(t), p) >= p.threshold * p.match * len(words(x))}


def test_pairs_against_brute_force_with_frequent_copies(spark):
    """Copies of one item in most texts do not make its seeds common."""
    r = random.Random(8)
    items = [(k, " ".join(make_words(7000 + k, 30, 3000))) for k in range(4)]
    docs = []
    for i in range(60):
        w = make_words(100 + i, 60, 3000)
        if i % 3:
            copy = items[0 if i % 4 else i % 4][1].split()
            for _ in range(i % 6):
                copy[r.randrange(len(copy))] = f"x{i}"
            w[30:30] = copy
        docs.append((i, " ".join(w)))
    p = Decontamination(few=1)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p).collect()
    assert {(x.id, x.item_id) for x in got} == brute_pairs(docs, items, p) and len(got) >= 30


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, " ".join(make_words(1, 30)), "a", "b", 1)], "doc_id long, text string, _gone string, gram string, id long")
    assert clean(docs, spark.createDataFrame([(1, "some other words here")], "item_id long, text string")).columns == docs.columns


def test_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, " ".join(make_words(6, 80)))], "item_id long, text string")
    assert contaminated(edge_docs, none).count() == 0 and contaminated(empty_docs, some).count() == 0
    assert sorted(x.id for x in contaminated(edge_docs, some).collect()) == [1, 2, 9]
    assert clean(edge_docs, some).count() == 8
