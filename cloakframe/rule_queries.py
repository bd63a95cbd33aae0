"""One query for each detection rule: texts made of the customers' keys run through the rule's whole stage, and the SQL
that says what must be found in them.

A case is a text and the value that the rule finds in it (None: nothing), as SQL expressions over ``k``, the
customer's key as text, which Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import rules
from .functions.rules import Rule
from .operators import text
from .shared import spread

K9, K2 = "lpad(k, 9, '0')", "lpad(substr(k, 1, 2), 2, '0')"
B, Q, N = "chr(92)", "chr(34)", "chr(10)"
UUID = "'123e4567-e89b-12d3-a456-' || lpad(k, 12, '0')"

STAGES: dict[str, tuple[Rule, ...]] = {
    "main": rules.MAIN, "identity": rules.IDENTITY, "hosts": rules.BARE_HOST, "folders": rules.SHARED_FOLDER, "prose": rules.PROSE, "dlp": rules.DLP,
    "terms": rules.host_terms(["plant-*"]), "names": rules.person_terms(["rossi"]), "clients": rules.client_terms(["Acme Water"]),
}

CASES: dict[str, tuple[str, list[tuple[str, str | None]]]] = {
    "url": ("main", [("'see https://h' || k || '.example.org/a?b=' || k || ' now'", "'https://h' || k || '.example.org/a?b=' || k"), ("'http:/x/' || k", None)]),
    "upn": ("main", [("'by bob' || k || '@CORP now'", "'bob' || k || '@CORP'"), ("'at @' || k", None)]),
    "mac": ("main", [(f"'from 00:1a:2b:3c:4d:' || {K2} || ' on'", f"'00:1a:2b:3c:4d:' || {K2}"), (f"'00-1A-2B-3C-4D-' || {K2}", f"'00-1A-2B-3C-4D-' || {K2}"), ("'at 10:42:' || k", None)]),
    "ipv6": ("main", [("'via 2001:db8::' || substr(k, 1, 4) || ' up'", "'2001:db8::' || substr(k, 1, 4)"), ("'std::vector ' || k", None)]),
    "sid": ("main", [("'by S-1-5-21-11-22-' || k || '-500 ok'", "'S-1-5-21-11-22-' || k || '-500'"), ("'S-1-5-18 ' || k", None)]),
    "opaqueid": ("main", [("'open WB-12345-' || k || ' now'", "'WB-12345-' || k"), ("'WB-1 ' || k", None)]),
    "labelled_id": ("main", [("'Workspace Name: ws-' || k || 'x'", "'ws-' || k || 'x'"), ("'detector id abcd' || k", "'abcd' || k"), ("'workspace of ' || k", None)]),
    "ipv4_scope": ("main", [("'from 10.1.2.' || (length(k) + 10) || ' to'", "'10.1.2.' || (length(k) + 10)"), ("'v 300.1.2.' || length(k)", None)]),
    "userpath": ("main", [(f"'C:' || {B} || 'Users' || {B} || 'bob' || k || {B} || 'x'", "'bob' || k"), ("'/home/ann' || k || '/x'", "'ann' || k"), ("'home ' || k", None)]),
    "winuser": ("main", [(f"'as ACME' || {B} || 'bob' || k || ' now'", f"'ACME' || {B} || 'bob' || k"), (f"'HKLM' || {B} || 'bob' || k", None)]),
    "userkv": ("main", [("'user=bob' || k || ';'", "'bob' || k"), ("'src_user: ann' || k", "'ann' || k"), ("'login=SYSTEM'", None), ("'users ' || k", None)]),
    "hostkv": ("main", [("'server=web-' || k", "'web-' || k"), ("'host DB' || k || ' up'", "'DB' || k"), ("'host alpha'", None)]),
    "cn": ("main", [("'CN=Bob ' || k || ',OU=x'", "'Bob ' || k"), ("'CN=Users,DC=x' || k", None)]),
    "fqdn": ("main", [("'at w' || k || '.corp.example.com today'", "'w' || k || '.corp.example.com'"), ("'in file' || k || '.txt here'", None)]),
    "identity_user": ("identity", [("'Account Name: bob' || k", "'bob' || k"), (f"{Q} || 'TargetUserName' || {Q} || ':' || {Q} || 'ann' || k || {Q}", "'ann' || k"), ("'Account Name: -'", None)]),
    "identity_domain": ("identity", [("'Subject Domain Name: ACME' || k", "'ACME' || k"), ("'Account Domain: WORKGROUP'", None)]),
    "identity_host": ("identity", [("'Workstation Name: PC' || k", "'PC' || k"), ("'Workstation Name: -'", None)]),
    "bare_host": ("hosts", [("'on srv-web-' || k || ' today'", "'srv-web-' || k"), ("'on dc' || substr(k, 1, 2) || ' now'", "'dc' || substr(k, 1, 2)"), ("'roma-dc on'", None), ("'sql-test up'", "'sql-test'"), ("'the server room ' || k", None), ("'a+srv-' || k || '='", None)]),
    "shared_folder": ("folders", [("'/personal/bob_' || k || '/Docs'", "'bob_' || k"), ("'/users/' || k", None)]),
    "host_term": ("terms", [("'on plant-' || k || ' now'", "'plant-' || k"), ("'plant ' || k", None)]),
    "person_term": ("names", [("k || ': m.rossi said'", "'m.rossi'"), ("k || ' Rossi'", "'Rossi'"), ("'rossini ' || k", None)]),
    "client": ("clients", [("k || ' AcmeWater!'", "'AcmeWater'"), ("k || ' acme_water'", "'acme_water'"), ("'acme ' || k", None)]),
    "identity_prose": ("prose", [("'user bob' || k || ' logged on'", "'bob' || k"), ("'User ann' || k || ' has not signed in'", "'ann' || k"), ("'user was logged on ' || k", None), ("'user bob' || k || ' left'", None)]),
    "private_key": ("dlp", [(f"'x -----BEGIN RSA PRIVATE KEY-----' || {N} || k || {N} || '-----END RSA PRIVATE KEY-----'", f"'-----BEGIN RSA PRIVATE KEY-----' || {N} || k || {N} || '-----END RSA PRIVATE KEY-----'"), ("'-----BEGIN ' || k", None)]),
    "url_parameter": ("dlp", [("'https://x.example/?token=abcd' || k", "'abcd' || k"), ("'https://x.example/?page=abcd' || k", None)]),
    "credential": ("dlp", [("'password: hunter2' || k", "'hunter2' || k"), ("'client_secret=abc' || k || 'defgh; x'", "'abc' || k || 'defgh'"), ("'session: opened.'", None), ("'password ' || k", None)]),
    "jwt": ("dlp", [("'eyJabcdefgh.abcdefgh.abcdefgh' || k", "'eyJabcdefgh.abcdefgh.abcdefgh' || k"), ("'eyJ.' || k", None)]),
    "cloud_key": ("dlp", [("'key AKIA' || lpad(k, 16, '0')", "'AKIA' || lpad(k, 16, '0')"), ("'ghp_abcdefghijklmnopqrst' || k", "'ghp_abcdefghijklmnopqrst' || k"), ("'AKIA' || k", None)]),
    "bearer": ("dlp", [("'Bearer abcdefgh' || k", "'abcdefgh' || k"), ("'bearer of ' || k", None)]),
    "iban": ("dlp", [("k || ' iban GB82 WEST 1234 5698 7654 32.'", "'GB82 WEST 1234 5698 7654 32'"), ("k || ' iban GB82 WEST 1234 5698 7654 33.'", None)]),
    "tax_id": ("dlp", [("k || ' RSSMRA85T10A562S,'", "'RSSMRA85T10A562S'"), ("k || ' RSSMRA85T10A562T,'", None)]),
    "azure": ("dlp", [(f"'id /subscriptions/' || {UUID} || '/resourceGroups/g' || k", f"'/subscriptions/' || {UUID} || '/resourceGroups/g' || k"), ("'/subscriptions/' || k", None)]),
    "arn": ("dlp", [("'arn:aws:iam::123456789012:user/u' || k", "'arn:aws:iam::123456789012:user/u' || k"), ("'arn:gcp:' || k", None)]),
    "aws_account": ("dlp", [("'aws account id: ' || lpad(k, 12, '1')", "lpad(k, 12, '1')"), ("'account id: ' || substr(k, 1, 3)", None)]),
    "vat": ("dlp", [(f"'VAT DE' || {K9}", f"'DE' || {K9}"), ("'P.IVA 00000017897'", "'00000017897'"), ("'p iva 12345678901'", None)]),
    "vat_prefixed": ("dlp", [(f"'by FR12' || {K9} || ', ok'", f"'FR12' || {K9}"), ("'by FR' || substr(k, 1, 4)", None)]),
    "phone": ("dlp", [(f"'tel: 0' || {K9}", f"'0' || {K9}"), ("'tel ' || substr(k, 1, 3)", None)]),
    "phone_labelled_plus": ("dlp", [(f"'call +39' || {K9} || '.'", f"'+39' || {K9}"), ("'+' || substr(k, 1, 4)", None)]),
    "address": ("dlp", [(f"'address: Main ' || k || {N} || 'x'", "'Main ' || k"), ("'addresses ' || k", None)]),
    "person_label": ("dlp", [(f"'full name: Ada Lovelace' || {N} || k", "'Ada Lovelace'"), ("'full name: ada ' || k", None)]),
    "street": ("dlp", [("'in Via Roma ' || substr(k, 1, 4) || ', x'", "'Via Roma ' || substr(k, 1, 4)"), ("'at 1' || substr(k, 1, 3) || ' Main street now'", "'1' || substr(k, 1, 3) || ' Main street'"), ("'via roma ' || k", None)]),
    "uuid": ("dlp", [(f"'id ' || {UUID} || ' x'", UUID), ("'right 1131f6aa-9c07-11d1-f79f-00c04fc2dcd2 ' || k", None)]),
}
NAMES = {"ipv4_scope": "ipv4", "phone_labelled_plus": "phone_international"}


def _query(name: str):
    stage, cases = CASES[name]

    def run(spark, sf_dir):
        keyed = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).withColumn("k", F.col("c_custkey").cast("string"))
        made = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.expr(t).alias("text")) for i, (t, _) in enumerate(cases)])).alias("c")
        texts = keyed.select("c_custkey", made).select("c_custkey", F.col("c.n").alias("n_case"), "c.text")
        return text.findings(texts, STAGES[stage]).where(F.col("rule") == NAMES.get(name, name)).select("c_custkey", "n_case", "value")

    run.__doc__ = f"Values that the rule {NAMES.get(name, name)} finds in made texts, with its whole stage."
    return run


def _sql(name: str) -> str:
    wanted = [f"SELECT c_custkey, {i} AS n_case, {v} AS value FROM t" for i, (_, v) in enumerate(CASES[name][1]) if v]
    return "WITH t AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer) " + " UNION ALL ".join(wanted)


QUERIES = {f"q_rule_{name}": _query(name) for name in CASES}
SQL = {f"q_rule_{name}": _sql(name) for name in CASES}
