"""Cases of the fourth round of findings."""

import pytest

from pyspark.sql import functions as F

from cloakframe import queries, shared
from cloakframe.functions import checks, rules
from cloakframe.functions.tokens import Keys
from cloakframe.operators import gate, text, vault
from cloakframe.plans import jobs
from cloakframe.sources import trees

KEYS = Keys.derive(b"k" * 32, "tests")

#: Addresses that look like tokens of ours: of 240.0.0.0/4, 198.18.0.0/15, and beside them others.
LOOKS = ["by 249.53.94.59 up", "%%% 248.167.124.71*** to 240.56.125.154, 240.56.125.154", "to 198.18.7.8 and 10.1.2.3", "eve@example.com at 254.1.2.3", "usr-abcdefgh@abcdef.masked", None, "nothing"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("looks")
    spark.createDataFrame(list(enumerate(LOOKS)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(7,), (8,), (7,)], "user_id long").write.parquet(str(path / "events.parquet"))
    return str(path)


def _as_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    con.execute(queries.SQL[name])
    names = sorted(d[0] for d in con.description)
    at = [[d[0] for d in con.description].index(n) for n in names]
    want = sorted(tuple(str(r[i]) for i in at) for r in con.fetchall())
    assert sorted(tuple(str(r[n]) for n in names) for r in queries.QUERIES[name](spark, sf).collect()) == want and want


@pytest.mark.parametrize("name", ["q_detect_ipv4", "q_detect_counts", "q_ip_scope", "q_mask_ipv4", "q_priority_finding", "q_tenant_networks", "q_top_values", "q_vault_assign", "q_vault_insert_missing", "q_vault_stats", "q_text_elide"])
def test_addresses_of_the_input_that_look_like_tokens_count(spark, sf, name):
    _as_sql(spark, sf, name)


def test_tokens_that_masks_wrote_do_not_count(spark):
    masked = spark.createDataFrame([("at 249.53.94.59, 198.18.7.8",), ("by host-abcdefgh.masked.local",), ("at 9.8.7.6",)], "text string")
    assert [r.value for r in gate.residuals(masked).collect()] == ["9.8.7.6"]
    assert text.findings(masked, tuple(r for r in rules.MAIN if r.name == "ipv4")).count() == 3


def test_account_numbers_are_those_of_countries(spark):
    assert not set(checks.OTHER_COUNTRIES.split()) & {c for codes in checks.IBAN_LENGTHS.values() for c in codes.split()}
    texts = ["sum db411a189a509b2298 onst", "pay GB82 WEST 1234 5698 7654 32 now", "by FO97 5432 0388 8999 44, DK5000400440116243", "of DZ580002100001113000000570", "pay GB61ABCDEF123456789"]
    compact = spark.createDataFrame([("DB411A189A509B2298",), ("GB61ABCDEF123456789",), ("DZ580002100001113000000570",)], "v string")
    assert [tuple(r) for r in compact.select(checks.valid_iban(F.col("v")), checks.country_iban(F.col("v"))).collect()] == [(True, False), (True, False), (True, True)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for found in (text.findings(df, tuple(r for r in gate.RESIDUAL if r.kind == "iban")), text.findings(df, rules.DLP).where("kind = 'iban'")):
        assert sorted(r.id for r in found.collect()) == [1, 2, 2, 3]


def test_values_that_look_like_tokens_are_masked_behind_any_mark(spark):
    hidden = ["on -250.86.128.35 on", "on .254.203.124.202!", "to @240.5.9.233", "by bob@198.18.7.8", "srv-241.172.57.208 up", "x -fd00:1234:1234:1234::1"]
    plain = ["version 240.999.1.2", "on 250.223.125.99_x on"]  # no addresses
    df = spark.createDataFrame(list(enumerate(hidden + plain)), "id long, text string")
    masked, rows = jobs.mask_known(df, KEYS)
    now = {r.id: r.text for r in masked.collect()}
    values = ("250.86.128.35", "254.203.124.202", "240.5.9.233", "198.18.7.8", "241.172.57.208", "fd00:1234:1234:1234::1")
    assert not [v for i, v in enumerate(values) if v in now[i]] and [now[len(hidden) + i] for i in range(2)] == plain
    back = vault.restore(masked, vault.sealed(rows, KEYS), KEYS, "id").orderBy("id").collect()
    assert [(r.text, r.n_unresolved) for r in back] == [(t, 0) for t in hidden + plain]


def test_documents_come_back_as_they_were_written(spark):
    docs = ['{"user":{"name":"bob7"},"message":"first\\n198.18.7.8, then\\t240.1.2.3 é","n":[1,2.50,null,true]}', '{\n  "src_ip": "10.1.2.3",\n  "message": "by bob@example.com"\n}\n', '{ "event": {"severity": 5},  "message":"nothing" }', " ", None, '{"message":"","user":{"name":"ann7"}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, value string")
    masked, rows = jobs.mask_json(df, KEYS)
    seen = "".join(r.value or "" for r in masked.collect())
    assert not [v for v in ("bob", "ann7", "198.18.7.8", "240.1.2.3", "10.1.2.3") if v in seen]
    back = jobs.restore_json(masked, rows, KEYS).orderBy("id").collect()
    assert [r.n_unresolved for r in back] == [0] * len(docs) and [r.value for r in back[1:]] == docs[1:]
    assert back[0].value == docs[0].replace("[1,2.50,null,true]", '["[ELIDED]","[ELIDED]",null,true]')


def test_frames_of_documents_hold_no_text(spark):
    docs = ['{"a":"x y","b":[{"c":"z"},7]}', '{ "a": "x"}', '{"a":1}', '{"a":"\\ud800"}', '{\n  "a": "x"\n}', "[", "", None]
    df = spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1)
    parts = trees.emptied(df, "value", "t", "h")
    assert [tuple(r) for r in parts.collect()] == [
        ('{"a":"","b":[{"c":""},7]}', ["x y", "z"], True), ('{ "a": "x"}', ["x"], False), ('{"a":1}', [], False), ('{"a":"\\ud800"}', ["�"], False), ('{\n  "a": ""\n}', ["x"], True), (None, None, False), ("", [], False), (None, None, False),
    ]
    assert [r.value for r in trees.refilled(parts, "value", "t", "h").collect()] == [None if d == "[" else d for d in docs]
    assert [r.value for r in trees.refilled(parts.withColumn("t", F.transform("t", lambda x: F.upper(x))), "value", "t", "h").limit(3).collect()] == ['{"a":"X Y","b":[{"c":"Z"},7]}', '{"a":"X"}', '{"a":1}']


def test_json_jobs_write_each_text_few_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "folder", lambda _: f"file://{tmp_path}/kept")
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.translate(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")), 256), 1, 24), "0123456789", "ghijklmnop")))
    spark.range(200).select("id", F.to_json(F.struct(F.struct(F.concat(F.lit("usr"), "id").alias("name")).alias("user"), words.alias("message"))).alias("value")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    masked, rows = jobs.mask_json(df, KEYS)
    back = jobs.restore_json(masked, rows, KEYS)
    assert sorted(map(tuple, back.drop("n_unresolved").collect())) == sorted(map(tuple, df.collect()))
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    assert size(tmp_path / "kept") < 3 * size(tmp_path / "in")  # masked, and in pieces; what was read is discarded
