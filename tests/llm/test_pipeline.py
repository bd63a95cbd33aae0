import corpus_pipeline as C
from cloakframe.llm.queries import OPERATORS

from .conftest import make_words
from .test_decontamination import smith_waterman  # noqa: F401
from .test_jaccard_join import brute as classes
from .test_quality_rules import counts


def tables(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(make_words(900, 40, 3000)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect_in_order(spark, tmp_path):
    text = {i: " ".join(make_words(i, 90, 3000)) for i in range(40)}
    text[40] = text[3] + " extra"  # a near copy
    text[41] = "too short"
    text[42] = "again and again " * 60
    text[43] = " ".join(make_words(43, 60, 3000) + make_words(900, 40, 3000))  # holds the test item
    text[44] = None
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in text.items()] + [(None, None, None, None, None)]
    tables(spark, tmp_path, docs)
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        kept[name] = sorted(r.doc_id for r in rows.collect())
        assert rows.columns[:5] == C.COLUMNS
    base = [i for i, t in text.items() if counts(t)[0] >= 50 and 2 * counts(t)[4] <= counts(t)[0]]
    assert kept["quality rules"] == sorted(base)
    group = classes([(i, text[i]) for i in base])
    lead = sorted(i for i in base if group[i][0] == i)
    assert kept["n-gram jaccard join"] == lead and 40 not in lead
    assert kept["benchmark decontamination"] == [i for i in lead if i != 43]
    assert set(kept["mixing to target weights"]) <= set(lead) and len(kept["mixing to target weights"]) > 15
    assert kept["sharding"] == kept["mixing to target weights"] and {"shard", "slot"} <= set(rows.columns)


def test_run_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [(i, " ".join(make_words(i, 90, 3000)), "en", "s", 1) for i in range(12)])
    out = C.run(spark, str(tmp_path)).collect()
    assert out and sorted(r.slot + 1 for r in out if r.shard == 0)[0] == 1
    none = tmp_path / "none"
    tables(spark, none, [])
    assert C.run(spark, str(none)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(f.__name__[2:].split("_")[0]) for f in OPERATORS) == list(range(1, 11))
