import random
import re

import numpy as np
import pyarrow as pa

from cloakframe.llm import quality_classifier as Q
from cloakframe.llm import toxicity as T
from cloakframe.llm import words as W

from .conftest import make_words

BAD = ["idiot", "moron", "worthless", "pathetic"]


def corpus(n=400):
    r = random.Random(5)
    docs, marks = [], []
    for i in range(n):
        w, quality, toxic = make_words(i, 80, 2000), 1, 0
        if i % 4 == 0:
            w, quality = [x for x in w[:10] for _ in range(8)], 0
        elif i % 4 == 1:
            toxic = 1
            for _ in range(4):
                w[r.randrange(80)] = r.choice(BAD)
        docs.append((i, " ".join(w)))
        marks.append((i, quality, toxic))
    return docs, marks


def test_quality_held_out(spark):
    docs, marks = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = Q.train(df, spark.createDataFrame(marks[:300], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in Q.classify(df, model).collect()}
    held = marks[300:]
    assert np.mean([got[i].selected == bool(q) for i, q, _ in held]) > 0.97
    mean = lambda rows: np.mean([got[i].expected_grade for i, _, _ in rows])
    assert mean([m for m in held if not m[1]]) < mean([m for m in held if m[2]]) < mean([m for m in held if m[1] and not m[2]])
    assert (np.diff(model.cuts) > 0).all()


def test_gradient_of_the_ordinal_model_descends():
    p = Q.QualityClassifier(buckets=256, steps=60)
    docs, marks = corpus(80)
    f = Q.features(W.text_column(pa.array([t for _, t in docs])), p)
    grade = np.array([0 if not q else 1 if t else 2 for _, q, t in marks])
    loss = lambda m: -np.log(Q.grade_chances(Q.linear(f, m), m.cuts)[np.arange(80), grade]).mean()
    start = Q.Model(np.zeros(3 * 256), np.zeros(Q.DENSE), np.array([0.0, 1.0]))
    assert loss(Q.fit(f, grade, p)) < 0.5 * loss(start)


def test_quality_edges(spark, edge_docs, empty_docs, labels, no_labels):
    model = Q.train(edge_docs, labels)
    out = Q.classify(edge_docs, model).collect()
    assert len(out) == 12 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    flat = {r.expected_grade for r in Q.classify(edge_docs, Q.train(edge_docs, no_labels)).collect()}
    assert len(flat) == 1
    assert Q.classify(empty_docs, Q.train(empty_docs, labels)).count() == 0


def test_restoring(spark):
    text = " ".join(BAD + ["trash", "stupid"] * 3) + " " + " ".join(make_words(1, 500))
    model = T.character_model(spark.createDataFrame([(text * 5,)], "text string"))
    p = T.Toxicity()
    for token in ("1d10t", "i.d.i.o.t", "i d i o t", "iiiidiot", "ID10T!!", "id!ot"):
        assert T.restore(T.noisy(token), model, p) == ["idiot"], token
    assert T.restore(T.noisy("m0r0n"), model, p) == ["moron"] and T.restore(T.noisy("tr4sh,"), model, p) == ["trash"]
    assert T.restore(T.noisy("stuuuupid"), model, p) == ["stupid"] and T.restore(T.noisy("w0rthless"), model, p) == ["worthless"]
    for token in ("1 d 1 0 t", "id.iot", "i.d.iot", "mo-r-on", "i/d/i/o/t", "i*d*i*o*t", "i,d,i,o,t"):
        assert T.restore(T.noisy(token), model, p) == (["moron"] if token.startswith("m") else ["idiot"]), token
    rows, words = T.Restorer(model, p).chunk(pa.array(["so (i d 1 o t.) there", "é t é", "1 2 3 4 5"], pa.large_string()))
    assert words[rows.tolist().index(0)] == "idiot" and 2 not in rows
    assert T.noisy("plain") is None and T.noisy("12345") is None and T.noisy("the###") is None


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(T.CLASSES), size=(T.CLASSES, T.CLASSES))).astype(np.float32)
    p = T.Toxicity()
    core = "a1b0c"
    options = [[("a", 0)], [("i", p.swap_cost), ("l", p.swap_cost), ("1", p.swap_cost)], [("b", 0)], [("o", p.swap_cost), ("0", p.swap_cost)], [("c", 0)]]

    def value(path):
        x = y = 0
        s = 0.0
        for out, cost in path:
            c = int(T.CLASS[ord(out)])
            s += float(model[x, y, c]) - cost
            x, y = y, c
        return s + float(model[x, y, 0]) + float(model[y, 0, 0])

    best = max(itertools.product(*options), key=value)
    assert T.restore(core, model, p) == ["".join(o for o, _ in best)]


def test_toxicity_held_out_and_obfuscated(spark):
    docs, marks = corpus(1000)
    hidden = [(1000 + k, " ".join(make_words(2000 + k, 60, 2000) + [w])) for k, w in enumerate(["1d10t", "m.o.r.o.n", "w0rthl3ss", "p4thetic"])]
    df = spark.createDataFrame(docs + hidden, "doc_id long, text string")
    model = T.train(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in T.score(df, model).collect()}
    import zlib

    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} >= {m[0] for m in held} and len(held) > 50
    assert np.mean([got[i].predicted == t for i, _, t in held]) > 0.97
    assert all(got[i].predicted == 1 for i, _ in hidden)


def test_toxicity_edges(spark, edge_docs, empty_docs, labels, no_labels):
    model = T.train(edge_docs, labels)
    out = T.score(edge_docs, model).collect()
    assert len(out) == 12 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1
    assert len({r.score for r in T.score(edge_docs, T.train(edge_docs, no_labels)).collect()}) == 1
    assert T.score(empty_docs, T.train(empty_docs, labels)).count() == 0


def test_long_tokens_take_linear_time(spark):
    import time

    model = T.character_model(spark.createDataFrame([("some words here",)], "text string"))
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        for token in ("ab.cd-" * (n // 6), "a1" * (n // 2), "x" * n, "." * n, "a" + "-" * n):
            core = T.noisy(token)
            if core:
                T.restore(core, model, T.Toxicity())
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] and took[1] < 30


def test_summary_against_brute_force(spark):
    """The measures of a text are sums over all its different words, computed here word by word."""
    model = T.character_model(spark.createDataFrame([("some plain words",)], "text string"))
    p = T.Toxicity(prefixes=())
    weights = np.random.default_rng(3).normal(0, 2, p.buckets)
    texts = ["", "one two three two one", " ".join(w for w in make_words(9, 3000, 900) if T.noisy(w) is None), "Ünï codé, words!"]
    got = T.summary(pa.array(texts, pa.large_string()), weights, T.Restorer(model, p), p)
    for text, row in zip(texts, got, strict=True):
        words = set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()))
        value = [float(weights[T.tokens(pa.array([w], pa.large_string()), T.Restorer(model, p), p)[2][0, 0]]) for w in words]
        value = [v for v in value if v > 0.5]
        want = [1, max(value, default=0), np.log1p(np.exp(value).sum()), np.log1p(sum(value)), np.log1p(sum(v * v for v in value)), np.log1p(sum(v > 2.5 for v in value)), np.log1p(len(words))]
        assert np.allclose(row, want)


def test_the_score_is_the_logistic_of_the_summary(spark):
    docs, marks = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.train(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    p = T.Toxicity()
    got = {r.doc_id: r.score for r in T.score(df, model).collect()}
    for i, text in docs[:40]:
        x = T.summary(pa.array([text], pa.large_string()), model.weights, T.Restorer(model.characters, p), p)[0]
        assert abs(got[i] - 1 / (1 + np.exp(-float(x @ model.beta)))) < 1e-9


def test_regression_finds_the_maximum():
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(400), rng.normal(3, 2, (400, 2))]
    y = (rng.random(400) < 1 / (1 + np.exp(2 - x[:, 1]))).astype(float)
    beta = T.regress(x, y, ridge=1e-9)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ beta)))).max() < 1e-4


def test_gradient_against_differences():
    p = Q.QualityClassifier(buckets=16, ridge=0.01)
    f = Q.features(pa.array([" ".join(make_words(i, 12 + i)) + ("\n#x\n#x" if i % 3 else "") for i in range(9)] + [""], pa.large_string()), p)
    grade = np.array([0, 1, 2, 2, 1, 0, 1, 2, 0, 0])
    x = np.random.default_rng(2).normal(0, 0.5, 3 * p.buckets + Q.DENSE + 2)
    _, grad = Q.loss_and_gradient(x, f, grade, p)
    for k in range(len(x)):
        up, down = x.copy(), x.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((Q.loss_and_gradient(up, f, grade, p)[0] - Q.loss_and_gradient(down, f, grade, p)[0]) / 2e-6 - grad[k]) < 1e-6


def test_grades_against_brute_force(spark):
    """Expected grade and tail probability, computed from the sigmoids of one document at a time."""
    docs, marks = corpus(120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = Q.QualityClassifier(buckets=256, steps=40)
    model = Q.train(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), p)
    got = {r.doc_id: r for r in Q.classify(df, model, p).collect()}
    for i, text in docs[:30]:
        f = Q.features(pa.array([text], pa.large_string()), p)
        score = sum(v * model.weights[k] for k, v in zip(f.index, f.value, strict=True)) + f.dense[0] @ model.dense
        below = [1 / (1 + np.exp(score - c)) for c in model.cuts]
        assert abs(got[i].tail_probability - (1 - below[0])) < 1e-9
        assert abs(got[i].expected_grade - ((below[1] - below[0]) + 2 * (1 - below[1]))) < 1e-9
        assert got[i].selected == (got[i].tail_probability >= p.select_at)


def test_the_sample_is_bounded_by_bytes(spark):
    docs = [(i, " ".join(make_words(i, 300))) for i in range(40)] + [(40, "x " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(41)], "doc_id long, quality int, toxic int")
    for p in (Q.QualityClassifier(max_bytes=10_000, steps=5), Q.QualityClassifier(max_bytes=1, steps=5), Q.QualityClassifier(max_rated=3, steps=5)):
        assert np.isfinite(Q.train(df, marks, p).weights).all()


def test_clashing_names(spark):
    docs, marks = corpus(40)
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in docs], "doc_id long, text string, _text string, _held string")
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for out in (T.score(df, T.train(df, marks)), Q.classify(df, Q.train(df, marks, Q.QualityClassifier(steps=3)), Q.QualityClassifier(steps=3))):
        assert out.where("_text = 'mine' AND _held = 'mine'").count() == 40
