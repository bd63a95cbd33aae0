import pytest

from cloakframe.functions import rules
from cloakframe.functions.tokens import Keys
from cloakframe.operators import gate, text, vault
from cloakframe.plans import jobs
from cloakframe.operators.vault_table import VaultTable
from cloakframe.streaming import masking

KEYS = Keys.derive(b"k" * 32, "demo")
LINES = [
    "mail Bob.Smith@example.com from 10.1.2.3 and 8.8.8.8, again bob.smith@example.com", "C:\\Users\\jdoe\\x ACME\\mrossi user=alice host: WKS-0421 web01.corp.local",
    "see https://u:p@www.example.com/a/0123456789abcdef0123456789abcdef?token=abcdef&d=2024-01-01&x=foo#t", "password: hunter2secret tel: +39 06 1234 5678 IBAN GB82 WEST 1234 5698 7654 32",
    "RSSMRA85T10A562S S-1-5-21-1-2-3-500 00:1a:2b:3c:4d:5e 2001:db8::1 CN=John Doe,OU=x", "User mrossi logged on; Account Name: jsmith dc01 srv-sso", None, "",
]
SECRET = ["bob.smith", "10.1.2.3", "8.8.8.8", "jdoe", "mrossi", "alice", "WKS-0421", "web01", "www.example.com", "0123456789abcdef", "hunter2", "1234 5678", "GB82", "RSSMRA85", "00:1a", "db8", "John Doe", "jsmith", "dc01"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "id long, text string")


@pytest.fixture(scope="module")
def masked(spark, lines):
    rows = text.mask_text(lines, KEYS).collect()
    return spark.createDataFrame(rows, "id long, text string")


def test_nothing_sensitive_is_left(masked):
    got = {r.id: r.text for r in masked.collect()}
    joined = "\n".join(t for t in got.values() if t).lower()
    assert not [s for s in SECRET if s.lower() in joined]
    assert got[6] is None and got[7] == "" and got[1].startswith("C:\\Users\\usr-") and "d=2024-01-01" in got[2] and got[4].split()[1].endswith("-500")
    mails = [w.strip(",") for w in got[0].split() if "@" in w]
    assert len(set(mails)) == 1


def test_masking_again_with_the_vault_changes_nothing(spark, lines):
    plain = lines.where("id <> 4")  # a masked domain SID looks like any other SID
    first, rows = jobs.mask_known(plain, KEYS)
    once = {r.id: r.text for r in first.collect()}
    again, more = jobs.mask_known(first, KEYS, known=rows)
    assert {r.id: r.text for r in again.collect()} == once and more.isEmpty()


def test_what_only_looks_like_a_token_is_masked(spark):
    texts = ["card 02:42:ac:11:00:02", "at 198.18.7.9 up", "via fd00:aaaa:bbbb:cccc::1", "http://198.19.3.4/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    masked, rows = jobs.mask(df, KEYS)
    got = {r.id: r.text for r in masked.collect()}
    assert not any(t.split()[-1 if i else -1] in got[i] for i, t in enumerate(texts[:1] + texts[2:3])) and "198.18.7.9" not in got[1] and "198.19.3.4" not in got[3]
    assert [r.text for r in vault.restore(masked, rows, KEYS, "id").orderBy("id").collect()] == texts
    assert gate.judge(masked, vault=rows).released and not gate.judge(df, vault=rows).released


def test_domains_that_are_kept_come_back(spark):
    df = spark.createDataFrame([(1, "on web01.corp.example.com now")], "id long, text string")
    for o in (text.Options(keep_domain=True), text.Options(keep_scope=False)):
        masked, rows = jobs.mask(df, KEYS, o)
        assert ("example.com" in masked.first().text) == o.keep_domain
        assert vault.restore(masked, rows, KEYS, "id").first().text == "on web01.corp.example.com now"


def test_clean_text_stays(spark):
    clean = ["The user experience was good at 10:42:01.", "version 1.2.3 of module foo/bar", "HKLM\\Software\\Run", "administrator logged on", "path C:\\Windows\\System32\\cmd.exe", "hash d41d8cd98f00b204e9800998ecf8427e", "ratio 3:4, price 12.50, localhost"]
    df = spark.createDataFrame(list(enumerate(clean)), "id long, text string")
    assert [r.text for r in text.mask_text(df, KEYS).orderBy("id").collect()] == clean


def test_configured_terms(spark):
    o = text.Options(host_terms=("KDA*QNS",), client_terms=("Acme Water Group",), client_mode="label", client_label="<C>", given_names=("mario",), family_names=("rossi",))
    df = spark.createDataFrame([(1, "on KDA77QNS for acme-water group by Rossi, Mario and x")], "id long, text string")
    out = text.mask_text(df, KEYS, o).first().text
    assert "KDA77" not in out and "<C>" in out and "ossi" not in out and out.endswith("and x")


def test_modes(spark):
    df = spark.createDataFrame([(1, "10.0.0.1 8.8.8.8 http://pub.example.com/x?token=abcd&q=word")], "id long, text string")
    inner = text.mask_text(df, KEYS, jobs.options("incident")).first().text
    assert "8.8.8.8" in inner and "10.0.0.1" not in inner and "pub.example.com/x?token=[ELIDED]&q=word" in inner


def test_policy(spark):
    with pytest.raises(ValueError):
        rules.policy({"nothing": "keep"})
    o = jobs.options(dlp={"phone": "keep"})
    df = spark.createDataFrame([(1, "tel: +39 06 1234 5678 password=abcdefgh")], "id long, text string")
    out = text.redact_residuals(text.mask_text(df, KEYS, o), o).first().text
    assert "+39 06 1234 5678" in out and "abcdefgh" not in out


def test_vault_round_trip_and_lookup(spark, lines, masked):
    found = jobs.all_findings(lines, text.Options()).cache()
    rows = vault.assign(found, KEYS)
    stored = vault.sealed(rows, KEYS)
    assert rows.count() == rows.select("token").distinct().count()
    back = {r.id: r for r in vault.restore(masked, stored, KEYS, "id").collect()}
    assert "bob.smith@example.com" in back[0].text.lower() and "10.1.2.3" in back[0].text and "ACME\\mrossi" in back[1].text and back[0].n_unresolved == 0
    hit = vault.lookup(stored, KEYS, "10.1.2.3").first()
    assert hit.raw == "10.1.2.3" and vault.lookup(stored, KEYS, hit.token).first().raw == "10.1.2.3"
    assert vault.assign(found, KEYS, stored).isEmpty()
    other = Keys.derive(b"k" * 32, "other")
    assert vault.assign(found, other).join(rows, "bidx").isEmpty()


def test_colliding_tokens_get_a_salt(spark):
    ips = spark.createDataFrame([("ipv4", f"10.{a}.{b}.{c}") for a in range(2) for b in range(20) for c in range(40)], "kind string, value string")
    rows = vault.assign(ips, KEYS)
    assert rows.count() == 1600 == rows.select("token").distinct().count() and rows.where("salt > 0").count() > 0
    again = vault.assign(ips.repartition(5), KEYS)
    assert rows.select("norm", "token").exceptAll(again.select("norm", "token")).isEmpty()


def test_subnets(spark):
    one = spark.createDataFrame([(f"10.0.{n}.{h}",) for n in (1, 2) for h in range(200)], "value string")
    rows = vault.subnet_tokens(one, KEYS)
    out = vault.subnet_map(rows)
    assert out.select("token").distinct().count() == 400 and out.selectExpr("substring_index(token, '.', 3)").distinct().count() == 2
    more = vault.subnet_map(vault.subnet_tokens(spark.createDataFrame([("10.0.1.250",), ("10.0.3.1",), ("10.0.1.7",)], "value string"), KEYS, rows))
    assert more.count() == 402 == more.select("token").distinct().count() and out.exceptAll(more).isEmpty()  # nothing is renumbered
    many = spark.createDataFrame([(f"10.{n // 250}.{n % 250}.1",) for n in range(300)], "value string")
    with pytest.raises(vault.TokenSpaceExhausted):
        vault.subnet_tokens(many, KEYS)


def test_gate(spark, lines, masked, tmp_path):
    safe = text.redact_residuals(masked)
    assert gate.judge(lines).n_residual > 0 and gate.judge(safe).released
    with pytest.raises(gate.Blocked):
        gate.release(lines, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.staging").exists()
    assert gate.release(safe, str(tmp_path / "good")).n_rows == 8 and spark.read.parquet(str(tmp_path / "good")).count() == 8
    with pytest.raises(FileExistsError):
        gate.release(safe, str(tmp_path / "good"))
    verdict, rows = jobs.release(lines.where("id in (0, 1)"), KEYS, str(tmp_path / "out"))
    back = vault.restore(spark.read.parquet(str(tmp_path / "out")), rows, KEYS, "id")
    assert verdict.released and back.where("id = 1").first().text == LINES[1]


def test_a_vault_is_archived(spark, tmp_path):
    path = str(tmp_path / "vault")
    for n in (1, 2):
        spark.range(1).write.parquet(path)
        assert vault.archive(path, spark).endswith(f"archive-{n}")
    assert not (tmp_path / "vault").exists()


def test_stream(spark, lines, tmp_path):
    lines.limit(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    o = text.Options(types=("email", "ipv4"))
    q = masking.start(stream, KEYS, str(tmp_path / "vault"), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), o)
    q.awaitTermination(120)
    out = {r.id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "@example.com" not in out[0] and VaultTable(spark, str(tmp_path / "vault")).read().where("kind = 'email'").count() == 1


def test_masking_uses_the_tokens_of_the_vault(spark, tmp_path):
    texts = [f"seen 10.{n // 500}.{n % 50}.{n % 250} then 10.{n // 500}.{n % 50}.{n % 250} address: near 10.{n // 500}.{n % 50}.{n % 250}; end" for n in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    o = text.Options(types=("ipv4",))
    out, stored = jobs.mask(df, KEYS, o, safe=False)
    n = len({t.split()[1] for t in texts})
    assert n > 900 and stored.where("kind = 'ipv4'").count() == n == out.selectExpr("split(text, ' ')[1]").distinct().count()
    back = {r.id: r for r in vault.restore(out, stored, KEYS, "id").collect()}
    assert [back[i].text for i in range(2000)] == texts and not any(r.n_unresolved for r in back.values())
    table = df.selectExpr("cast(id AS string) AS record", "split(text, ' ')[1] AS source_ip", "text AS message")
    out, _, stored = jobs.mask_table(table, KEYS, o, keep=("record",))
    for column in ("source_ip", "message"):
        back = vault.restore(out, stored, KEYS, "record", column).select("record", column)
        assert back.exceptAll(table.select("record", column)).isEmpty()
    for part in (df.where("id < 1000"), df.where("id >= 1000")):
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = masking.start(stream, KEYS, str(tmp_path / "vault"), lambda x, n: x.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), o)
    q.awaitTermination(120)
    back = vault.restore(spark.read.parquet(str(tmp_path / "out")), VaultTable(spark, str(tmp_path / "vault")).read(), KEYS, "id")
    assert back.select("id", "text").exceptAll(df).isEmpty() and back.count() == 2000


def test_the_vault_has_what_urls_and_accounts_hold(spark):
    line = "see https://web.example.com/a/0123456789abcdef0123456789abcdef and http://10.9.8.7/b, bob@CORP user=pc77$ ACME\\wks12$ CN=Jane Roe,OU=x"
    df = spark.createDataFrame([(1, line)], "id long, text string")
    out, stored = jobs.mask(df, KEYS)
    masked = out.first().text
    assert not [s for s in ("example", "0123456789abcdef", "10.9.8.7", "bob", "CORP", "pc77", "wks12", "Jane") if s in masked]
    back = vault.restore(out, stored, KEYS, "id").first()
    assert back.text == line and back.n_unresolved == 0
