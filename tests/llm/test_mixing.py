from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakframe.llm.mixing import Mixing, calibrated, mix, rake


def test_raking_matches_the_plain_algorithm(spark):
    cells = [(s, x, t, 10 + 7 * i + 3 * j * j + 11 * k * (i + 1)) for i, s in enumerate("abc") for j, x in enumerate(["en", "de"]) for k, t in enumerate(["p", "q"])]
    aims = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"p": 0.4, "q": 0.6}}
    got = {(r.source, r.lang, r.topic): r.weight for r in rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), Mixing(targets=aims)).collect()}
    w = {c[:3]: float(c[3]) for c in cells}
    for _ in range(200):
        for d, m in enumerate(("source", "lang", "topic")):
            total = defaultdict(float)
            for k, x in w.items():
                total[k[d]] += x
            w = {k: x * aims[m][k[d]] / total[k[d]] for k, x in w.items()}
    assert all(abs(got[k] - w[k]) < 1e-5 for k in w)


def test_probabilities_are_calibrated(spark):
    rows = [(i, "word " * (20 + i % 50), ["en", "de"][i % 5 == 0], f"s{i % 7 and i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = Mixing(keep=0.6, temperature=0.3)
    out = mix(docs, p).cache()
    total, expected, drawn = out.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0))).first()
    assert abs(expected / total - 0.6) < 1e-6 and abs(drawn / total - 0.6) < 0.03
    assert out.where("probability > 1 OR probability < 0").isEmpty()
    again = mix(docs.repartition(7), p)
    assert out.where("sampled").select("doc_id").exceptAll(again.where("sampled").select("doc_id")).isEmpty()


def test_zero_targets_and_edges(spark, edge_docs, empty_docs):
    out = mix(edge_docs).collect()
    assert len(out) == 12 and all(0 <= r.probability <= 1 for r in out)
    assert {r.topic for r in out if r.doc_id in (3, 4, 5)} == {"empty"} and all(r.sampled for r in out if r.doc_id in (3, 4, 5))
    only = mix(edge_docs, Mixing(targets={"lang": {"en": 1.0}})).collect()
    assert all(r.probability == 0 for r in only if r.lang != "en" and r.n_tokens)
    assert mix(empty_docs).count() == 0


def water_filling(cells, keep):
    """Probabilities by bisection on c in sum of tokens * min(1, c * weight / tokens)."""
    budget = min(keep * sum(t for t, _ in cells), sum(t for t, w in cells if w > 0))
    lo, hi = 0.0, 1e12
    for _ in range(300):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(t, c * w) for t, w in cells) < budget else (lo, c)
    return [min(1.0, hi * w / t) if t and w else (1.0 if not t else 0.0) for t, w in cells]


@pytest.mark.parametrize("keep", [0.05, 0.4, 0.7, 0.97, 1.0])
def test_water_filling_against_bisection(spark, keep):
    cells = [(f"s{i}", "en", "t", 3 + 17 * i * i, float((i * 7919) % 13) / 10) for i in range(24)] + [("none", None, "empty", 0, 0.0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, weight double")
    got = {r.source: r.probability for r in calibrated(df, Mixing(keep=keep)).collect()}
    want = water_filling([(c[3], c[4]) for c in cells], keep)
    assert all(abs(got[c[0]] - w) < 1e-6 for c, w in zip(cells, want, strict=True))


def test_margins_that_cannot_be_met_are_named(spark):
    cells = spark.createDataFrame([("a", "en", "t", 5), ("b", "de", "t", 5)], "source string, lang string, topic string, tokens long")
    aims = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.raises(ValueError, match="cannot be met"):
        rake(cells, Mixing(targets=aims, strict=True))
    assert rake(cells, Mixing(targets=aims)).first().margin_error > 0.1


def test_a_topic_column_and_many_partitions_give_the_same(spark):
    rows = [(i, "word " * (5 + i % 9), "en" if i % 3 else "de", f"s{i % 4}", f"t{i % 2}", "mine") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string, _source string")
    one = mix(docs, Mixing(topic_column="kind")).collect()
    two = mix(docs, Mixing(topic_column="kind", small_cells=0)).collect()
    key = lambda out: sorted((r.doc_id, r.topic, round(r.probability, 9), r.sampled) for r in out)
    assert key(one) == key(two) and {r.topic for r in one} == {"t0", "t1"} and {r._source for r in one} == {"mine"}
