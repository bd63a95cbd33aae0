import random
import re

import numpy as np

from cloakframe.llm import words as W
from cloakframe.llm.substring_dedup import SubstringDedup, remove_repeats, sliding_argmin

from .conftest import make_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - size + 1):
                key = tuple(w[s : s + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows, p):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, p).collect()), key=str)
    assert got == brute(rows, p.min_words)


def test_shared_passages_in_different_surroundings(spark):
    r = random.Random(1)
    passages = [make_words(100 + k, 70) for k in range(4)]
    rows = []
    for i in range(60):
        w = make_words(i, r.randint(0, 150), 3000)
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, 10), r.randint(55, 70)))
            at = r.randint(0, len(w))
            w[at:at] = p[a:b]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(70 + k, rows[k * 3][1]) for k in range(8)] + [(200, "the same " * 400), (201, "the same " * 300), (202, "same the " * 40)]
    check(spark, rows, SubstringDedup())


def test_small_frames_and_ties(spark):
    rows = [(i, " ".join(make_words(i % 7, 30 + i, 12))) for i in range(40)] + [(3, " ".join(make_words(3, 33, 12)))]
    check(spark, rows, SubstringDedup(min_words=8, anchor_words=4))


def test_edges(spark, edge_docs, empty_docs):
    out = remove_repeats(edge_docs).collect()
    assert len(out) == 12
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == 80 and by[2].kept_text == "" and by[3].kept_text == "" and by[6].n_words == 60_000
    assert by[9].n_removed == 80 and by[9].kept_text == "tail words here" and by[9].removed_spans[0].asDict() == {"first": 0, "end": 80}
    assert all(r.n_removed == 0 for r in out if r.doc_id is None)
    assert remove_repeats(empty_docs).count() == 0


def test_sliding_argmin():
    x = np.random.default_rng(0).integers(0, 5, 200)
    for width in (1, 2, 7, 26):
        assert sliding_argmin(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(200 - width + 1)]


def test_words_split_like_the_pattern():
    import pyarrow as pa

    texts = ["a b", "", "  x\x0by \x1f z", "é\tß\n", None, "q"]
    w = W.split(W.text_column(pa.array(texts, pa.string())))
    got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.rows[i], w.rows[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
