import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from cloakframe.functions.tokens import Keys
from cloakframe.operators import text, vault
from cloakframe.operators.vault_table import VaultTable
from cloakframe.plans import jobs

KEYS = Keys.derive(bytes(32), "writers")


def found(spark, values, kind="user"):
    return spark.createDataFrame([(kind, v) for v in values], "kind string, value string")


def test_eight_writers_of_forty_values(spark, tmp_path):
    path = str(tmp_path / "vault")
    values = [f"user{i}" for i in range(40)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda n: VaultTable(spark, path).assign(found(spark, values[n:] + values[:n]), KEYS), range(8)))
    table = VaultTable(spark, path)
    rows = table.read().collect()
    assert len(rows) == len({r.bidx for r in rows}) == len({r.token for r in rows}) == 40
    one = {r.bidx: r.token for r in vault.assign(found(spark, values), KEYS).collect()}
    assert {r.bidx: r.token for r in rows} == one
    version = table.version()
    assert table.compact() == version + (len(table.folders(version)) > 1) and table.read().count() == 40
    assert table.assign(found(spark, values), KEYS) == table.version()  # nothing new, no version


def colliding(spark):
    """Two addresses with one unsalted token."""
    rows = spark.range(2000).selectExpr("'ipv4' AS kind", "concat('10.7.', id div 250, '.', id % 250) AS value")
    seen = {}
    for r in vault.salted(vault.values(rows, KEYS).selectExpr("*", "0 AS salt"), KEYS).collect():
        if r.token in seen:
            return seen[r.token], r.raw
        seen[r.token] = r.raw
    raise AssertionError("no collision")


def test_a_loser_with_a_taken_token_assigns_again(spark, tmp_path):
    a, b = colliding(spark)
    table = VaultTable(spark, str(tmp_path / "vault"))
    rows = {v: vault.sealed(vault.assign(found(spark, [v], "ipv4"), KEYS, table.read(0)), KEYS) for v in (a, b)}
    assert table.commit(rows[a], 0) == 1
    assert table.commit(rows[b], 0) is None and table.version() == 1  # its token stands for another value by now
    table.assign(found(spark, [b, a], "ipv4"), KEYS)
    held = table.read().collect()
    assert table.version() == 2 and len({r.token for r in held}) == len(held) == 2


def test_a_loser_leaves_out_what_others_wrote_alike(spark, tmp_path):
    table = VaultTable(spark, str(tmp_path / "vault"))
    mine, theirs = (vault.sealed(vault.assign(found(spark, v), KEYS), KEYS) for v in (["ann", "bob"], ["bob", "eve"]))
    assert table.commit(theirs, 0) == 1 and table.commit(mine, 0) == 2
    assert table.read().count() == 3 and table.read(1).count() == 2
    assert table.commit(theirs, 0) == 2  # all of it is there


def test_texts_masked_by_two_jobs_at_once_come_back(spark, tmp_path):
    a, b = colliding(spark)
    o = text.Options(types=("ipv4",), only=("main",))
    parts = [spark.createDataFrame([(i, f"from {x} to 10.9.9.9")], "id long, text string") for i, x in enumerate((a, b))]
    tables = [VaultTable(spark, str(tmp_path / "vault")) for _ in parts]
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda p: jobs.mask_into(p[0], KEYS, p[1], o)[0], zip(parts, tables, strict=True)))
    rows = tables[0].read()
    for part, masked in zip(parts, done, strict=True):
        assert masked.first().text != part.first().text
        assert vault.restore(masked, rows, KEYS, "id").first().text == part.first().text


def test_empty_vault(spark, tmp_path):
    table = VaultTable(spark, str(tmp_path / "vault"))
    assert table.version() == 0 and table.read().count() == 0 and table.assign(found(spark, []), KEYS) == 0


DOCS = ['{"user":{"name":"bob7"},"src_ip":"10.1.2.3","message":"mail ann@example.com from 10.1.2.3","n":[1,2.5,true,null],"password":"hunter2!"}', '{\n  "host": {"name": "srv-1"},\n  "severity": 3\n}\n', "  ", None, '[{"user":"bob7"},{"user":"eve"}]']


def test_json_goes_through_the_vault_and_back(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, value string").withColumn("_free", __import__("pyspark").sql.functions.lit("x"))
    masked, rows = jobs.mask_json(df, KEYS)
    got = {r.id: r.value for r in masked.collect()}
    first = json.loads(got[0])
    assert first["password"] == "[ELIDED]" and first["user"]["name"].startswith("usr-") and "@example.com" not in first["message"] and first["src_ip"] in first["message"]
    assert json.loads(got[4])[0]["user"] == first["user"]["name"] and got[2] == "  " and got[3] is None and got[1].endswith("}\n") and "\n  " in got[1]
    back = {r.id: r for r in jobs.restore_json(masked, rows, KEYS).collect()}
    want = dict(enumerate(DOCS))
    for i in (0, 1, 4):
        a, b = json.loads(back[i].value), json.loads(want[i])
        if i == 0:
            a.pop("password"), b.pop("password"), a.pop("n"), b.pop("n")
        assert a == b and back[i].n_unresolved == 0


def test_no_json_ends_the_job(spark):
    df = spark.createDataFrame([(1, '{"a":')], "id long, value string")
    with pytest.raises(Exception, match="no JSON document"):
        jobs.mask_json(df, KEYS)
    assert jobs.mask_json(df, KEYS, invalid="null")[0].first().value is None
