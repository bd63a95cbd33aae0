"""Name tables, known hosts, subnets, scans, SQL functions, sweeps of any length, open names."""

import pytest

from cloakframe.functions import checks, rules, sql
from cloakframe.functions.tokens import Keys
from cloakframe.operators import classify, fields, text, vault
from cloakframe.plans import jobs
from cloakframe.sources.names import read_names
from pyspark.sql import functions as F

KEYS = Keys.derive(b"r" * 32, "round")


@pytest.mark.parametrize("name", "api_key secret_key private_key card_number account_number passport_number social_security_number tax_code date_of_birth action_token type_of_secret home_region apiKey userPassword".split())
def test_open_names_do_not_stay(name):
    assert classify.decide(name, {"n_filled": 5, "kind": None, "n_kind": 0, "n_long": 0}).action in ("redact", "mask")


@pytest.mark.parametrize("name", "severity event_time status_code o_orderstatus bytes dest_port eventType lineNumber".split())
def test_operational_names_stay(name):
    assert classify.decide(name, None).action == "keep"


def test_fields_tell_categories():
    want = {"user.full_name": "person_name", "customer_phone": "phone", "billing.iban": "iban", "event.code": None, "shippingAddress": "address", "client_secret": "credentials", "company_vat_id": "vat_id"}
    assert {n: fields.category(n) for n in want} == want


def test_ibans_before_words(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013000 was paid to us", "GB82 WEST 1234 5698 7654 32 for invoice", "XX00 no iban 12345 here", "DE88 3704 0044 0532 0130 00 is wrong"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stage = tuple(r for r in rules.DLP if r.name == "iban")
    out = [r.t for r in df.select(text.run_stage(F.col("t"), stage, lambda c: F.concat(c["prefix"], F.lit("#"), c["rest"])).alias("t")).collect()]
    assert out == ["IBAN # ok", "# was paid to us", "# for invoice", texts[3], texts[4]]
    within = df.select(checks.iban_within(F.regexp_replace("t", "^IBAN ", "")).alias("v")).collect()
    assert [r.v for r in within] == ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "", ""]


def test_priority_beats_place(spark):
    """A finding of higher priority stays though one of lower priority starts before it and would cover it."""
    df = spark.createDataFrame([("address: Main VAT DE123456789 tel: 0123456789",)], "t string")
    out = df.select(text.run_stage(F.col("t"), rules.DLP, lambda c: F.concat(c["prefix"], F.lit("<"), c["rule"], F.lit(">"), c["rest"])).alias("t")).first().t
    assert out == "address: Main VAT <vat> tel: <phone>"


def test_letters_of_any_script_in_mail(spark):
    df = spark.createDataFrame([("by ünter.mueller@example.de and rené@example.com.",)], "t string")
    stage = tuple(r for r in rules.MAIN if r.name == "email")
    assert df.select(text.run_stage(F.col("t"), stage, lambda c: F.lit("#")).alias("t")).first().t == "by # and #."


def test_names_from_files(spark, tmp_path):
    (tmp_path / "nomi_it.txt").write_text("# list\nMario\nAda,12\n<html>\nthis is prose about names\n")
    (tmp_path / "cognomi.txt").write_text("Rossi;x\nBianchi\tx\n")
    (tmp_path / "other.txt").write_text("Nobody\n")
    assert {tuple(r) for r in read_names(spark, str(tmp_path)).collect()} == {("mario", "given"), ("ada", "given"), ("rossi", "family"), ("bianchi", "family")}


def test_sweep_any_length(spark):
    values = [("address", "Old Mill Lane"), ("address", "Old Mill Lane 5 Upper Town"), ("host", "srv-1"), ("host", "server"), ("person", "Ada Byron")]
    rows = vault.sealed(vault.assign(spark.createDataFrame(values, "kind string, value string"), KEYS), KEYS)
    token = {r.raw: r.token for r in rows.withColumn("raw", F.expr("'x'")).limit(0).collect()}
    token = {v: vault.lookup(rows, KEYS, v).first().token for _, v in values}
    texts = ["at OLD mill lane 5 upper town, Old Mill Lane.", "srv-1 server srv-10 x@srv-1", "Ada Byron, ada byron", None, "", "Old Mill  Lane"]
    out = [r.text for r in vault.sweep_text(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), rows, KEYS, "id").orderBy("id").collect()]
    assert out[0] == f"at {token['Old Mill Lane 5 Upper Town']}, {token['Old Mill Lane']}."
    assert out[1] == f"{token['srv-1']} server srv-10 x@srv-1" and out[2] == f"{token['Ada Byron']}, ada byron" and out[3:] == texts[3:]


def test_scan_writes_a_plan_once(spark, tmp_path):
    df = spark.createDataFrame([("10.1.2.3", f"v{i % 3}", "high") for i in range(9)], "src_ip string, api_key string, severity string")
    path = str(tmp_path / "plan.json")
    assert jobs.scan(df, path, dry_run=True).count() == 3 and not (tmp_path / "plan.json").exists()
    got = {r.column: r for r in jobs.scan(df, path).collect()}
    assert got["api_key"].action == "redact" and got["api_key"].samples == ["v0", "v1", "v2"] and got["severity"].samples == ["high"]
    (tmp_path / "plan.json").write_text((tmp_path / "plan.json").read_text().replace('"redact"', '"keep"'))
    jobs.scan(df, path)
    assert jobs.load_policy(spark, path)["api_key"] == ("keep", None) and classify.decide("api_key", None, overrides=jobs.load_policy(spark, path)).action == "keep"


def test_sql_functions(spark):
    sql.register(spark, KEYS, "t_")
    from cloakframe.functions import tokens

    df = spark.createDataFrame([("10.1.2.3", "Bob@Example.com")], "ip string, mail string")
    row = df.selectExpr("t_mask_ip(ip) AS ip", "t_token('email', mail) AS mail", "t_is_internal(ip) AS inner").first()
    want = df.select(tokens.token(KEYS, "ipv4", F.col("ip"), F.lit(True)).alias("ip"), tokens.token(KEYS, "email", F.col("mail")).alias("mail")).first()
    assert (row.ip, row.mail, row.inner) == (want.ip, want.mail, True)
