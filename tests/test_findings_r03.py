"""Cases of the third round of findings."""

from pyspark.sql import functions as F

from cloakframe import queries
from cloakframe.functions import rules, tokens
from cloakframe.functions.tokens import Keys, is_token
from cloakframe.operators import classify, gate, lookups, text, vault
from cloakframe.plans import jobs
from cloakframe.shared import spread

KEYS = Keys.derive(b"k" * 32, "tests")


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_letters_of_tokens_are_not_in_clear(spark):
    lines = ["at host-acorpabc.masked.local user=usr-abcbann2 src_ip=198.18.1.2", "by srv7.corp.local", "user=ann7 src_ip=198.18.1.2", "src_ip=10.1.2.7"]
    assert [r[0] for r in _texts(spark, *lines).orderBy("id").select(queries._in_clear(F.col("text"))).collect()] == [False, True, True, True]


def test_hosts_tokens_are_no_web_tokens(spark):
    out = text.mask_text(_texts(spark, "at host-eyjabcde.masked.local", "key eyJabcdefgh.abcdefgh.abcdefgh"), text.Maker(KEYS, None, F.array().cast("array<string>"))).orderBy("id").collect()
    assert [r.text for r in out] == ["at host-eyjabcde.masked.local", "key [ELIDED]"]


def test_the_gate_takes_no_hash_for_an_account_number(spark):
    rows = _texts(spark, "sum ee179f36ae81aaf03691dad06f99093fcb2517", "bb70a80bde80a551da erorou in ereant eringa", "pay GB82WEST12345698765432and", "pay GB82-WEST-1234-5698-7654-32 now")
    found = text.findings(rows, tuple(r for r in gate.RESIDUAL if r.kind == "iban"))
    assert sorted(r.id for r in found.collect()) == [2, 3]


def test_more_addresses_than_the_narrow_space_holds(spark):
    ips = spark.range(70_000).selectExpr("'ipv4' AS kind", "concat('10.', id div 65536, '.', id div 256 % 256, '.', id % 256) AS value")
    rows = vault.assign(ips, KEYS)
    assert rows.count() == 70_000 == rows.select("token").distinct().count() == rows.where(is_token(F.col("token"))).count()
    assert rows.where("token NOT LIKE '198.18.%' AND NOT token RLIKE '^24[0-7][.]'").isEmpty() and not rows.where("token LIKE '24%'").isEmpty()
    some = rows.where("salt >= 4").limit(20).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("at "), "token", F.lit(", x")).alias("text"), F.concat(F.lit("at "), "norm", F.lit(", x")).alias("was"))
    back = vault.restore(some, vault.sealed(rows, KEYS), KEYS, "id").collect()
    assert back and all(r.text == r.was and r.n_unresolved == 0 for r in back)


def test_tokens_behind_marks_come_back(spark):
    texts = _texts(spark, "to @mail5.example.com", "ip-10.1.2.3 up", "by.+1 (988) 555-2485and more")
    masked, rows = jobs.mask_known(texts, KEYS)
    assert not masked.where("text RLIKE 'mail5|10[.]1|555'").count()
    back = vault.restore(masked, vault.sealed(rows, KEYS), KEYS, "id").orderBy("id").collect()
    assert [r.text for r in back] == [r.text for r in texts.orderBy("id").collect()]


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "x"))
    dealt = spread(spark.read.parquet(str(tmp_path / "x")))
    sizes = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < 1000


def _in_one_network(spark, n):
    return spark.range(n).selectExpr("id", "concat('10.1.', id div 200, '.', id % 200) AS src_ip", "concat('bob', id, '@example.com') AS email")


def test_the_vault_is_made_once_if_masking_anew_finds_the_same(spark, monkeypatch):
    calls, assign = [], vault.assign
    monkeypatch.setattr(vault, "assign", lambda *a, **k: calls.append(1) or assign(*a, **k))
    df = _in_one_network(spark, 1200)  # some of so many addresses get a salt
    masked, _, rows = jobs.mask_table(df, KEYS, keep=("id",))
    assert len(calls) == 1
    tokens_ = {r.token for r in rows.where("kind = 'ipv4'").collect()}
    assert len(tokens_) == 1200 == masked.select("src_ip").distinct().count() and tokens_ == {r.src_ip for r in masked.select("src_ip").collect()}


def test_moved_values_are_told_by_their_salt(spark):
    ips = _in_one_network(spark, 1200).selectExpr("id AS key", "'ipv4' AS kind", "src_ip AS value")
    rows = vault.assign(ips.select("kind", "value"), KEYS)
    told = {tuple(r) for r in vault.moved(rows, KEYS).collect()}
    assert told and told == {tuple(r) for r in vault.moved_among(ips, rows, KEYS).collect()}
    assert {m for r in vault.issued(ips, vault.moved(rows, KEYS), "key").collect() for m in r["_issued"].items()} == {(f"{k}|{n}", t) for k, n, t in told}
    slots = vault.assign(ips.select("kind", "value"), KEYS, subnets=True)
    assert {tuple(r) for r in vault.moved(slots, KEYS, subnets=True).collect()} == {tuple(r) for r in vault.moved_among(ips, slots, KEYS).collect()}


def test_columns_of_a_row_are_restored_together(spark):
    df = spark.createDataFrame([(1, "10.1.2.3", None, "no 7"), (2, None, "eve@example.com", None), (3, "10.1.2.4", "bob@example.com", "")], "id long, src_ip string, email string, note string")
    masked, _, rows = jobs.mask_table(df, KEYS, keep=("id", "note"))
    joined = masked.withColumn("note", F.concat("note", F.lit(" "), "src_ip", F.lit(" 198.18.250.251 "), F.coalesce("email", F.lit("-"))))
    out = vault.restore(joined, rows, KEYS, "id", ["note", "email", "src_ip"]).orderBy("id").collect()
    assert [tuple(r)[:4] for r in out] == [(1, "10.1.2.3", None, "no 7 10.1.2.3 198.18.250.251 -"), (2, None, "eve@example.com", None), (3, "10.1.2.4", "bob@example.com", " 10.1.2.4 198.18.250.251 bob@example.com")]
    assert [r.n_unresolved for r in out] == [1, 0, 1]
    assert jobs.restore_table(joined, rows, KEYS).columns == [*df.columns, "n_unresolved"]


def test_findings_are_classified_once(spark):
    texts = _texts(spark, "password: hunter2x and eyJabcdefgh.abcdefgh.abcdefgh", "password ", None, "iban GB82 WEST 1234 5698 7654 32 and words; password: opened. pwd=abcdef9")
    found = text.findings(texts, rules.DLP)
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, 0, "credential", "secret", "credentials", "hunter2x"), (0, 1, "jwt", "secret", "credentials", "eyJabcdefgh.abcdefgh.abcdefgh"),
        (3, 0, "iban", "iban", "iban", "GB82 WEST 1234 5698 7654 32"), (3, 2, "credential", "secret", "credentials", "abcdef9"),
    ]
    plan = found.where("rule = 'credential'").select("id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z]{3,14}[.!?]$") == 1  # the check of a rule


def test_only_columns_that_names_leave_open_are_profiled(spark, monkeypatch):
    asked, profile = [], classify.profile
    monkeypatch.setattr(classify, "profile", lambda df: asked.append(df.columns) or profile(df))
    df = spark.createDataFrame([(1, "v1", "bob7@example.com", "high", "10.1.2.3")], "id long, api_key string, zeta string, severity string, src_ip string")
    plan = {d.column: (d.kind, d.action, d.by) for d in classify.plan(df, keep=("id",))}
    assert asked == [["zeta"]] and plan["zeta"] == ("email", "mask", "values") and plan["api_key"][1] == "redact" and plan["severity"][1] == "keep" and plan["src_ip"][1] == "mask"
    classify.plan(df.drop("zeta"), keep=("id",))
    assert len(asked) == 1


def test_the_gate_passes_over_elided_cells(spark, monkeypatch):
    seen, residuals = [], gate.residuals
    monkeypatch.setattr(gate, "residuals", lambda df, *a: seen.append(df.count()) or residuals(df, *a))
    df = spark.createDataFrame([(text.ELIDED, None), ("[ELIDED] bob7@example.com ann7@example.com", text.ELIDED), ("", "bob7@example.com")], "a string, b string")
    verdict = gate.judge(df, text=["a", "b"])
    assert (verdict.n_rows, verdict.n_residual, verdict.n_blocked) == (3, 3, 0) and seen == [3]
    assert gate.judge(df, text="b").n_residual == 1 and seen == [3, 1]


def test_only_names_beside_capitalised_words_are_looked_up(spark):
    names = spark.createDataFrame([("mario", "given"), ("rossi", "family"), ("anna", "given"), ("d'amico", "family")], "name string, role string")
    texts = _texts(spark, "Yes Mario, said Anna. then Rossi", "by Dr Mario Rossi, and xAnna D'Amico", "D'Amico, Anna_Rossi or Mario  Rossi.", None, "no names")
    met = {r.id: (r.g, r.f) for r in lookups.with_names(texts, names, "text", "g", "f").collect()}
    assert met == {0: (["mario"], []), 1: (["anna", "mario"], ["d'amico", "rossi"]), 2: (["anna", "mario"], ["d'amico", "rossi"]), 3: ([], []), 4: ([], [])}
    masked, rows = jobs.mask_known(texts, KEYS, jobs.options(only=("prose",)), names=names)
    listed, _ = jobs.mask_known(texts, KEYS, jobs.options(only=("prose",), given_names=("mario", "anna"), family_names=("rossi", "d'amico")))
    assert sorted(map(tuple, masked.fillna("").collect())) == sorted(map(tuple, listed.fillna("").collect())) and {r.norm for r in rows.collect()} == {"mario rossi", "anna_rossi", "mario  rossi"}


def test_words_between_names_are_not_cut(spark):
    texts = _texts(spark, "Mario Rossi", "x Mario  Rossi, Anna Rossi.", "by\nMario Rossi\nfoo", "7 Mario Rossi.com", "7Mario Rossi", "Mario Rossi-x", "Mario Rossi7", "Mario Rossi.7", "Mario Rossi Mario", "Ed Mario and Rossi", "xMario Rossi", "", "Mario Rossi Anna Rossi")
    person, names = (lambda v: tokens.token(KEYS, "person", F.lit(v))), (["mario", "anna"], ["rossi"])
    a, b, c = texts.limit(1).select(person("Mario Rossi"), person("Mario  Rossi"), person("Anna Rossi")).first()
    out = [r[0] for r in texts.orderBy("id").select(text.mask_pairs(F.col("text"), *names, text.Maker(KEYS))).collect()]
    assert out == [a, f"x {b}, {c}.", f"by\n{a}\nfoo", f"7 {a}.com", "7Mario Rossi", "Mario Rossi-x", "Mario Rossi7", "Mario Rossi.7", f"{a} Mario", "Ed Mario and Rossi", "xMario Rossi", "", f"{a} {c}"]


def test_matches_are_checked_before_they_are_named(spark):
    texts = _texts(spark, "VAT DE123456789, p.iva 00000017897; vat it 00000 017897", "VAT IT12345678901 iva X-1234567-Y", "by NL123456789B01, ok", "vat vat-abcdefghijkl usr-abcdefgh", "vat usr-abcdefgh", "\x03VAT \x02DE\x01987654321")
    found = text.findings(texts, rules.DLP)
    assert sorted((r.id, r.at, r.rule, r.kind, r.category, r.value) for r in found.collect()) == [
        (0, 0, "vat", "vat", "vat_id", "DE123456789"), (0, 1, "vat", "vat", "vat_id", "00000017897"), (2, 0, "vat_prefixed", "vat", "vat_id", "NL123456789B01"), (5, 0, "vat", "vat", "vat_id", "DE987654321"),
    ]
    plan = found.where("rule = 'vat'").select("id", "value")._jdf.queryExecution().optimizedPlan().toString()
    (made,) = (line for line in plan.splitlines() if "Generate" in line)
    assert "person_name" not in made and made.count(r"[\s.-]+") == 2  # a value is stripped once by each rule of VAT numbers


def test_words_that_begin_alike_are_tried_together(spark):
    assert rules.any_of("adc,ad,api,sql,x y,x,c.so,-a,-a b") == r"(?:\-a[\s_.-]?b|c\.so|a(?:dc|pi|d)|sql|x(?:[\s_.-]?y|)|\-a)"
    texts = _texts(spark, "on srv-web-7 and ADC-7, dc1 sql-web sqlx-7 x-sql", "api-a1 apix-1 app7 appx7 WEB_dc esxi3 esx3 es3")
    assert [r.value for r in text.findings(texts, rules.BARE_HOST).orderBy("id", "at").collect()] == ["srv-web-7", "ADC-7", "dc1", "sql-web", "api-a1", "app7", "WEB_dc", "esxi3", "esx3"]
