"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, network, rules, tokens
from .functions.tokens import BASE32, Keys, pads
from . import rule_queries
from .operators import classify, fields, gate, nested, spans, text, vault
from .operators.kits import KITS
from .plans import jobs
from .shared import spread
from .sources import documents as doc_formats
from .sources import lines, trees

#: Keys of the demonstration tenant; real secrets come from the caller.
DEMO = Keys.derive(bytes(range(32)), "demo")
BY_NAME = {r.name: r for r in rules.MAIN + rules.DLP}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.findings(docs, tuple(BY_NAME[n] for n in names))


# DuckDB pieces -------------------------------------------------------------------------------------


def _hmac(key: bytes, message: str) -> str:
    inner, outer = pads(key)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def _seed(kind: str, norm: str, salt: str = "'0'") -> str:
    return _hmac(DEMO.sub("pseudo"), f"{kind} || '|' || {norm} || '|' || {salt}")


def _bidx(kind: str, norm: str) -> str:
    return _hmac(DEMO.sub("blind-idx"), f"{kind} || '|' || {norm}")


def _tag(h: str, n: int) -> str:
    bits = f"CAST('0x' || substr({h}, 1, 15) AS BIGINT)"
    return " || ".join(f"substr('{BASE32}', CAST(({bits} >> {55 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for k in range(n))


EMAIL_SQL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
IPV4_SQL = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
_IPS = rf"""ips AS (SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4_SQL}')) AS v FROM documents)
  WHERE list_max([CAST(x AS INTEGER) FOR x IN string_split(v, '.')]) <= 255 AND NOT regexp_matches(v, '(^|\.)0[0-9]'))"""
_MAILS = f"mails AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS value FROM documents)"
_NUMBER = "(CAST(split_part(value,'.',1) AS BIGINT)*16777216 + CAST(split_part(value,'.',2) AS BIGINT)*65536 + CAST(split_part(value,'.',3) AS BIGINT)*256 + CAST(split_part(value,'.',4) AS BIGINT))"


def _internal_sql() -> str:
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in network.INTERNAL]
    return "(" + " OR ".join(f"{_NUMBER} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"


_IPV4_TOKEN = "CASE WHEN {inner} THEN '198.18.' ELSE '198.19.' END || CAST(CAST('0x' || substr(h,1,2) AS INTEGER) AS VARCHAR) || '.' || CAST(CAST('0x' || substr(h,3,2) AS INTEGER) AS VARCHAR)"
_MAIL_TOKEN = "'usr-' || " + _tag("h", 8) + " || '@' || " + _tag("hd", 6) + " || '.masked'"
_HOSTS = r"hosts AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS host FROM pages)"


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]*)", 1))


# queries -------------------------------------------------------------------------------------------


def q_detect_email(spark, sf_dir):
    return _found(spark, sf_dir, "email").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def q_detect_ipv4(spark, sf_dir):
    return _found(spark, sf_dir, "ipv4").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def q_detect_counts(spark, sf_dir):
    return _found(spark, sf_dir, "email", "ipv4").groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))


def q_ip_scope(spark, sf_dir):
    found = _found(spark, sf_dir, "ipv4").withColumn("internal", network.is_internal(F.col("value")))
    return found.groupBy("internal").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def q_tenant_networks(spark, sf_dir):
    nets = ("100.0.0.0/6", "192.0.0.0/4", "not a network")
    inside = network.in_networks(F.col("value"), nets)
    return _found(spark, sf_dir, "ipv4").select("value", inside.alias("inside")).distinct()


def q_mask_email_tokens(spark, sf_dir):
    return _found(spark, sf_dir, "email").select("value").distinct().select("value", tokens.token(DEMO, "email", F.col("value")).alias("token"))


def q_mask_user_tokens(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    return users.select("user_id", "n_events", tokens.token(DEMO, "user", F.col("user_id").cast("string")).alias("token"))


def q_mask_ipv4(spark, sf_dir):
    ips = _found(spark, sf_dir, "ipv4").select("value").distinct()
    masked = ips.select("value", tokens.token(DEMO, "ipv4", F.col("value"), network.is_internal(F.col("value"))).alias("token"))
    return masked.groupBy("token").agg(F.count("*").alias("n_values"), F.min("value").alias("least"))


def q_prefixed_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Name "), F.col("c_custkey")).alias("v"))
    kinds = ("person", "phone", "opaque", "address", "cloud", "host")
    return c.select("c_custkey", *[tokens.token(DEMO, k, F.col("v")).alias(k) for k in kinds])


def q_blind_index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tokens.blind_index(DEMO, "person", F.lower("c_name")).alias("bidx"))


def q_text_elide(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stage = (BY_NAME["email"], BY_NAME["ipv4"])
    out = docs.withColumn("text", text.run_stage(F.col("text"), stage, lambda c: F.concat(c["prefix"], F.lit(text.ELIDED)), text.no_token))
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").cast("long").alias("n_chars"))


def q_url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    part = lambda i: F.regexp_extract("url", r"^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)
    return p.select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"))


def q_url_mask(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.mask_url(F.col("url"), DEMO, text.Options()).alias("url"))


def q_url_sanitise(spark, sf_dir):
    """Mode none: only sensitive parameters are elided."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.mask_url(F.col("url"), DEMO, text.Options(url_mode="none")).alias("url"))


def q_json_flatten(spark, sf_dir):
    return trees.flatten(table(spark, sf_dir, "events"), "event_id", "props").withColumnRenamed("id", "event_id")


def q_json_redact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", trees.redact(F.col("props"), ["k"]).alias("props"))


def _typed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("u"), n, F.lit("@example.com")).alias("contact"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 300).cast("string")).alias("address_seen"),
        F.concat(F.lit("srv"), n, F.lit(".corp.local")).alias("where_seen"), F.col("event_type").alias("what"), F.when(F.col("event_id") % 3 == 0, n).alias("maybe"),
    )


def q_sniff_profile(spark, sf_dir):
    return classify.profile(_typed(spark, sf_dir))


def q_classify_columns(spark, sf_dir):
    """Decisions for the columns of six tables, from their names and one profile each."""
    out = None
    for name in ("customer", "orders", "events", "documents", "pages", "conversations"):
        df = table(spark, sf_dir, name)
        seen = {r["column"]: r.asDict() for r in classify.profile(df).collect()}
        rows = [(name, d.column, d.kind, d.action, d.by) for d in (classify.decide(c, seen.get(c)) for c in df.columns)]
        part = spark.createDataFrame(rows, "table_name string, column string, kind string, action string, decided_by string")
        out = part if out is None else out.union(part)
    return out


#: (source, number, kit, fingerprint): the sources of ``q_nested_kits``, one for each kit.
SOURCES = [(g, j, k.id, f, w) for g, k in enumerate(KITS[i] for i in sorted(KITS)) for j, (f, w) in enumerate(k.fingerprints.items())]


def q_nested_kits(spark, sf_dir):
    """The vendor of each source of a table that mixes nested documents: a document holds one of the names that tell its source's
    vendor; two sources have no vendor, one of them with a single name that tells one."""
    n = len(KITS) + 2
    sizes = spark.createDataFrame([(g, j, sum(s[0] == g for s in SOURCES), f) for g, j, _, f, _ in SOURCES] + [(n - 2, 0, 1, "some.thing"), (n - 1, 0, 1, SOURCES[0][3])], "g int, j int, size int, form string")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), (F.col("c_custkey") % n).cast("int").alias("g"))
    named = own.join(F.broadcast(sizes), "g").where("floor(k / %d) %% size = j" % n)
    doc = F.concat(F.lit('[{"_source":{"'), F.replace("form", F.lit("."), F.lit('":[{"')), F.lit('":"v'), "k", F.lit('"'), F.expr("repeat('}]', size(split(form, '[.]')) - 1)"), F.lit("}}]"))
    found = nested.detect(named.select("g", doc.alias("value")), "value", "json", "g")
    return found.select(F.col("by").alias("source"), "kit", F.round("confidence", 6).alias("confidence"), "n_prints", "weight")


def q_column_policy(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    D = classify.Decision
    plan = [D("c_custkey", None, "keep", "config"), D("c_name", "person", "mask", "config"), D("c_nationkey", None, "keep", "config"), D("c_acctbal", None, "redact", "config"), D("c_mktsegment", None, "drop", "config")]
    return classify.apply_plan(c, plan, DEMO)


def q_cell_lists(spark, sf_dir):
    """Cells with several addresses, masked one by one with their separators kept."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("[10.1.1."), (F.col("user_id") % 200).cast("string"), F.lit("; 8.8.8."), (F.col("event_id") % 200).cast("string"), F.lit("]")).alias("cell"))
    return e.select("event_id", classify.masked_cell("ipv4", F.col("cell"), DEMO, text.Options(ip_mode="internal")).alias("cell"))


def q_dlp_counts(spark, sf_dir):
    """International phone numbers only, which SQL can express; ``q_dlp_report`` has all rules."""
    return _found(spark, sf_dir, "phone_international").groupBy("category", "rule").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def q_dlp_report(spark, sf_dir):
    """What all personal-data rules find in whole texts, by category and rule."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text.findings(docs, rules.DLP).groupBy("category", "rule").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


_ACCOUNT = "lpad(cast(doc_id AS string), 14, '0')"
_IBAN = f"concat('GB', lpad(cast(98 - cast(concat('32142829', {_ACCOUNT}, '161100') AS decimal(38, 0)) % 97 AS string), 2, '0'), 'WEST', {_ACCOUNT})"


def q_iban_prose(spark, sf_dir):
    """Whole texts with an account number before words, closed up or in groups of four: what the personal-data rules put in place of account
    numbers, and how many the gate, which has a test of its own, sees in the unmasked text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("iban", F.expr(_IBAN))
    spaced = F.concat_ws(" ", *[F.substring("iban", 4 * i + 1, 4) for i in range(6)])
    docs = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" paid to "), F.when(F.col("doc_id") % 2 == 0, F.col("iban")).otherwise(spaced), F.lit(" for invoice 7")))
    masked = text.run_stage(F.col("text"), rules.DLP, lambda c: text.hidden(c, DEMO, text.Options(), rules.DLP))
    found = docs.select("doc_id", F.array_join(F.array_sort(F.regexp_extract_all(masked, F.lit("(iban-[a-z2-7]{12})"))), ",").alias("tokens"))
    own = tuple(r for r in gate.RESIDUAL if r.kind == "iban")
    seen = text.findings(docs.select("doc_id", "text"), own).groupBy("doc_id").agg(F.count("*").alias("n_gate"))
    return found.join(seen, "doc_id", "left").select("doc_id", "tokens", F.coalesce("n_gate", F.lit(0)).alias("n_gate"))


CLOSED = "api_key secret_key private_key card_number account_number passport_number social_security_number tax_code date_of_birth action_token type_of_secret home_region password".split()


def q_columns_fail_closed(spark, sf_dir):
    """Columns whose names hold a harmless word, and are not harmless; only whole operational names stay."""
    c = _customers(spark, sf_dir, *[f"'v' || k || 'x{i}' AS {n}" for i, n in enumerate(CLOSED)], "'high' AS severity", "c_custkey AS event_count")
    masked, _, _ = jobs.mask_table(c, DEMO, keep=("c_custkey",))
    return masked.select("c_custkey", *CLOSED, "severity", F.col("event_count").cast("long").alias("event_count"))


def q_sql_functions(spark, sf_dir):
    """Tokens made in SQL by the registered functions are those of the columns."""
    from .functions import sql

    sql.register(spark, DEMO)
    c = _customers(spark, sf_dir, "c_custkey % 250 AS n")
    e = c.selectExpr("c_custkey", "'bob' || c_custkey || '@Example.com' AS mail", "'10.1.' || n || '.9' AS inner_ip", "'8.8.' || n || '.9' AS outer_ip", "'+39 06-' || c_custkey AS phone")
    return e.selectExpr("c_custkey", "ps_token('email', mail) AS mail", "ps_mask_ip(inner_ip) AS inner_ip", "ps_mask_ip(outer_ip) AS outer_ip", "ps_token('phone', phone) AS phone", "ps_blind_index('email', mail) AS bidx", "ps_is_token(ps_token('host', mail)) AS own")


def q_scan_samples(spark, sf_dir):
    """The ten least values of every column of three tables, from one pass each."""
    parts = [classify.samples(table(spark, sf_dir, n)).withColumn("table_name", F.lit(n)) for n in ("customer", "nation", "region")]
    return reduce(DataFrame.unionByName, parts).where("column <> 'c_acctbal'")


def q_subnet_mask(spark, sf_dir):
    """Addresses masked so that those of one network stay in one, and restored: per text whether the two of a network still share one, and
    whether the third, of another, does not."""
    net = "(c_custkey % 60)"
    texts = _customers(spark, sf_dir, f"'10.1.' || {net} || '.' || (c_custkey % 250) || ' and 10.1.' || {net} || '.' || (c_custkey % 240 + 1) || ' or 10.2.' || {net} || '.7' AS text")
    masked, rows = jobs.mask_known(texts, DEMO, jobs.options(types=("ipv4",), only=("main",), keep_subnets=True))
    part = lambda i: F.substring_index(F.element_at(F.split("text", " (?:and|or) "), i), ".", 3)
    looked = masked.select("c_custkey", (part(1) == part(2)).alias("together"), (part(1) != part(3)).alias("apart"), F.col("text").startswith("198.18.").alias("hidden"))
    out = vault.restore(masked, vault.sealed(rows, DEMO), DEMO, "c_custkey")
    return out.select("c_custkey", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_unresolved").join(looked, "c_custkey")


def q_person_tables(spark, sf_dir):
    """Pairs of names from a table of many thousand names, in whole texts: the same rows as with the lists as literals."""
    c = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL")
    letters = F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")
    names = c.select(F.explode(F.array(F.struct(F.concat(F.lit("mar"), letters).alias("name"), F.lit("given").alias("role")), F.struct(F.concat(F.lit("ross"), letters).alias("name"), F.lit("family").alias("role")))).alias("x")).select("x.*")
    docs = spread(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    mine = F.translate((F.col("doc_id") % 100).cast("string"), "0123456789", "abcdefghij")
    texts = docs.select("doc_id", F.concat("text", F.lit(" | by Mar"), mine, F.lit(" Ross"), mine, F.lit(", not Mar"), mine, F.lit(" Bianchi")).alias("text"))
    masked, _ = jobs.mask_known(texts, DEMO, jobs.options(only=("prose",)), names=names)
    return masked.select("doc_id", F.md5(F.encode(F.substring_index("text", " | ", -1), "UTF-8")).alias("digest"))


def q_url_known_hosts(spark, sf_dir):
    """URLs whose public hosts stay, but for those that the vault knows."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see "), F.col("url"), F.lit(" and https://www.unknown.example/a")).alias("text"), _host().alias("host"))
    known = vault.sealed(vault.assign(p.where("page_id % 2 = 0").select(F.lit("fqdn").alias("kind"), F.col("host").alias("value")), DEMO), DEMO)
    masked, _ = jobs.mask_known(p.select("page_id", "text"), DEMO, jobs.options("incident", types=("url",), only=("main",)), known=known)
    hosts = F.regexp_extract_all("text", F.lit("https?://([^/:?#]*)"))
    return masked.select("page_id", hosts[0].alias("first"), hosts[1].alias("second"))


def q_luhn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b[0-9]{16}\b)"))).alias("number"))
    return docs.select("doc_id", "number", checks.luhn(F.col("number")).alias("valid")).distinct()


def _ibans(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0")).alias("iban"))


def q_iban_mod97(spark, sf_dir):
    return _ibans(spark, sf_dir).select("c_custkey", checks.valid_iban(F.col("iban")).alias("valid"))


def q_vat(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 11, "0").alias("v"))
    return o.select("o_orderkey", checks.valid_vat(F.col("v")).alias("bare"), checks.valid_vat(F.concat(F.lit("IT"), F.col("v"))).alias("italian"), checks.valid_vat(F.concat(F.lit("DE"), F.substring("v", 3, 9))).alias("german"))


def _found_values(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("value"))
    return _found(spark, sf_dir, "email", "ipv4").select("kind", "value").union(users)


def q_vault_assign(spark, sf_dir):
    return vault.assign(_found_values(spark, sf_dir), DEMO).select("bidx", "kind", "norm", "hits", "token")


def q_vault_insert_missing(spark, sf_dir):
    """Only values that the vault lacks are added."""
    found = _found_values(spark, sf_dir)
    old = vault.assign(found.where("kind = 'user' AND cast(value AS bigint) % 2 = 0"), DEMO)
    return vault.assign(found, DEMO, old).groupBy("kind").agg(F.count("*").alias("n_new"), F.sum("hits").alias("n_hits"))


def q_vault_stats(spark, sf_dir):
    return vault.stats(vault.assign(_found_values(spark, sf_dir), DEMO))


def q_owned_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", tokens.token(DEMO, "person", F.col("c_name")).alias("token"))
    issued = vault.assign(table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("person").alias("kind"), F.col("c_name").alias("value")), DEMO)
    return vault.owned(c, issued)


def q_host_aliases(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.lit("fqdn").alias("kind"), _host().alias("value"))
    return vault.aliases(vault.assign(hosts, DEMO), DEMO)


def q_host_labels(spark, sf_dir):
    return vault.host_labels(table(spark, sf_dir, "pages").select(_host().alias("value")))


def q_sweep_known(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    hosts = table(spark, sf_dir, "pages").select(F.lit("fqdn").alias("kind"), _host().alias("value"))
    return vault.sweep(pages, vault.assign(hosts, DEMO), DEMO, "page_id", "html").groupBy("page_id", "kind", "token").agg(F.count("*").alias("n"))


def q_subnet_tokens(spark, sf_dir):
    ips = table(spark, sf_dir, "events").select(F.concat(F.lit("10.0."), (F.col("user_id") % 40).cast("string"), F.lit("."), (F.col("event_id") % 50).cast("string")).alias("value"))
    return vault.subnet_map(vault.subnet_tokens(ips, DEMO))


def q_reverse_roundtrip(spark, sf_dir):
    """Texts masked by all stages with the vault's tokens and restored through it are the originals.  What is
    elided for good is left out: secrets, and URLs, whose parameters are."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    o = jobs.options(types=tuple(r.name for r in rules.MAIN if r.kind != "url"), dlp={k: "keep" for k, a in rules.DEFAULT_POLICY.items() if a == "redact"})
    masked, rows = jobs.mask_known(docs, DEMO, o)
    out = vault.restore(masked, vault.sealed(rows, DEMO), DEMO, "doc_id")
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_unresolved")


def q_priority_finding(spark, sf_dir):
    """The first finding of each document by category weight, then place."""
    from pyspark.sql import Window

    found = _found(spark, sf_dir, "email", "ipv4")
    rank = F.when(F.col("kind") == "email", 100).otherwise(60)
    order = Window.partitionBy("doc_id").orderBy(F.desc(rank), F.desc(F.length("value")), "value")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "kind", "value")


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    who, value = F.col("user_id").cast("string"), F.col("event_type")
    return e.select(
        "event_id",
        F.concat(F.lit(r"CEF:0|Acme\|Co|Prod|1.0|"), F.col("event_id"), F.lit("|"), value, F.lit("|5|suser=user "), who, F.lit(r" msg=a\=b act="), value).alias("cef"),
        F.concat(F.lit("LEEF:2.0|Acme|Prod|1.0|"), F.col("event_id"), F.lit("|^|usrName=user "), who, F.lit("^act="), value).alias("leef"),
        F.concat(F.lit("<13>Jan  1 10:00:00 host"), who, F.lit(' app: user="user '), who, F.lit('" action='), value).alias("syslog"),
    )


def _parsed(spark, sf_dir, fmt, key):
    parse, render = lines.PARSERS[fmt]
    df = _lines(spark, sf_dir).select("event_id", fmt, parse(F.col(fmt)).alias("r"))
    pick = F.element_at(F.filter("r.pairs", lambda p: p["key"] == key), 1)["value"]
    return df, pick, (render(F.col("r")) == F.col(fmt)).alias("same")


def q_cef_parse(spark, sf_dir):
    df, pick, same = _parsed(spark, sf_dir, "cef", "suser")
    msg = F.element_at(F.filter("r.pairs", lambda p: p["key"] == "msg"), 1)["value"]
    return df.select("event_id", F.col("r.header")[1].alias("vendor"), F.col("r.header")[5].alias("name"), pick.alias("suser"), msg.alias("msg"), same)


def q_leef_parse(spark, sf_dir):
    df, pick, same = _parsed(spark, sf_dir, "leef", "usrName")
    return df.select("event_id", F.col("r.header")[4].alias("code"), pick.alias("user_name"), F.size("r.pairs").alias("n_pairs"), same)


def q_syslog_parse(spark, sf_dir):
    df, pick, same = _parsed(spark, sf_dir, "syslog", "user")
    return df.select("event_id", lines.syslog_host(F.col("r.prefix")).alias("host"), pick.alias("user_name"), same)


def q_cef_mask(spark, sf_dir):
    df, _, _ = _parsed(spark, sf_dir, "cef", "suser")
    out = lines.transform_pairs(F.col("r"), lambda k, v: F.when(k == "suser", tokens.token(DEMO, "user", v)).otherwise(v))
    return df.select("event_id", lines.render_cef(out).alias("line"))


def q_kv_transpose(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.explode(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))).alias("key", "value"))
    return lines.transpose(rows, "event_id", "key", "value").select("event_id", F.col("fields")["type"].alias("type"), F.col("fields")["user"].alias("user"))


def q_field_registry(spark, sf_dir):
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    D = classify.Decision
    plan = [D("c_custkey", None, "keep", "config"), D("c_name", "person", "mask", "config"), D("c_acctbal", None, "redact", "config")]
    news = classify.field_report(before, classify.apply_plan(before, plan, DEMO), plan, "c_custkey").withColumn("source", F.lit("customer"))
    return classify.merge_registry(news, news)


def q_gate_residuals(spark, sf_dir):
    """International phone numbers in texts as they are, by source, which SQL can express; the gate itself
    is ``q_gate_report``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = text.findings(docs, (BY_NAME["phone_international"],))
    return found.groupBy("source").agg(F.count("*").alias("n_residual"), F.count_distinct("doc_id").alias("n_docs"))


def q_gate_report(spark, sf_dir):
    """What the gate finds in masked texts whose main stage masked e-mail only, by source and rule."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    o = text.Options(types=("email",))
    found = gate.residuals(text.mask_text(docs, DEMO, o), o)
    return found.groupBy("source", "category", "rule").agg(F.count("*").alias("n_residual"), F.count_distinct("doc_id").alias("n_docs"))


def q_gate_judge(spark, sf_dir):
    """The gate's verdict on texts masked by all stages, with the vault that issued their tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    masked, rows = jobs.mask(docs, DEMO)
    verdict = gate.judge(masked, text.Options(), "text", rows)
    return spark.createDataFrame([(verdict.n_rows, verdict.n_residual, verdict.n_blocked, verdict.released)], "n_rows long, n_residual long, n_blocked long, released boolean")


def _customers(spark, sf_dir, *exprs):
    keyed = spread(table(spark, sf_dir, "customer").select("c_custkey")).withColumn("k", F.col("c_custkey").cast("string"))
    return keyed.select("c_custkey", *[F.expr(e) for e in exprs])


ADDRESSES = "'10.' || (c_custkey % 200) || '.' || (c_custkey // 200 % 250) || '.7 and 8.' || (c_custkey % 190) || '.' || (c_custkey // 190 % 250) || '.9; 10.' || (c_custkey % 230) || '.' || (c_custkey // 230 % 250) || '.5, 9.' || (c_custkey % 180) || '.' || (c_custkey // 180 % 250) || '.3'"


def q_many_addresses(spark, sf_dir):
    """Texts with so many addresses that tokens collide, masked with the vault's tokens and restored: all as they were."""
    texts = _customers(spark, sf_dir, ADDRESSES.replace("//", "div") + " AS text")
    masked, rows = jobs.mask_known(texts, DEMO, jobs.options(types=("ipv4",), only=("main",)))
    out = vault.restore(masked, vault.sealed(rows, DEMO), DEMO, "c_custkey")
    return out.select("c_custkey", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_unresolved")


def q_foreign_tokens(spark, sf_dir):
    """Values of the input that look like tokens are masked like others, and come back."""
    texts = _customers(spark, sf_dir, "'card 02:42:ac:11:00:' || lpad(substr(k, 1, 2), 2, '0') || ' at 198.18.7.' || (c_custkey % 250) AS text")
    masked, rows = jobs.mask_known(texts, DEMO, jobs.options(types=("ipv4", "mac"), only=("main",)))
    out = vault.restore(masked.withColumn("kept_text", F.col("text")), vault.sealed(rows, DEMO), DEMO, "c_custkey")
    clear = F.col("kept_text").contains("02:42:ac:11")
    return out.select("c_custkey", F.md5(F.encode("text", "UTF-8")).alias("digest"), "n_unresolved", clear.alias("in_clear"))


def q_json_mask_nested(spark, sf_dir):
    """Leaves at every depth masked, redacted or kept by their paths; numbers by path too."""
    doc = """'{"a":{"b":[{"user":{"name":"u' || user_id || '"}},{"n":' || (event_id % 1000) || '.0,"d":{"e":{"f":{"g":{"h":{"i":{"j":"x' || user_id || '"}}}}}}}]},"ok":true}' AS doc"""
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id")).select("event_id", F.expr(doc))
    decide = lambda path: ("mask", "user") if path.endswith("user.name") else ("redact", None) if path.endswith(("[].n", ".j")) else ("keep", None)
    return trees.mask_json(events, "event_id", "doc", decide, lambda kind, v: tokens.token(DEMO, kind, v))


def q_json_roundtrip(spark, sf_dir):
    """Documents as JSON, masked leaf by leaf through the vault and restored; nothing that was masked is seen in between.  Secrets and
    URLs, which are elided for good, are left out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    who, where = F.concat(F.lit("usr"), F.col("doc_id")), F.concat(F.lit("10.1."), F.col("doc_id") % 250, F.lit(".7"))
    doc = F.to_json(F.struct(F.struct(F.struct(who.alias("name")).alias("user")).alias("actor"), F.array(F.struct(where.alias("src_ip"), F.lit(6).alias("severity"))).alias("net"), F.col("text").alias("message")))
    o = jobs.options(types=tuple(r.name for r in rules.MAIN if r.kind != "url"), dlp={k: "keep" for k, a in rules.DEFAULT_POLICY.items() if a == "redact"})
    masked, rows = jobs.mask_json(docs.select("doc_id", doc.alias("value")), DEMO, o)
    left = masked.select("doc_id", (F.get_json_object("value", "$.actor.user.name").rlike("^usr[0-9]+$") | F.get_json_object("value", "$.net[0].src_ip").startswith("10.1.")).alias("in_clear"))
    out = jobs.restore_json(masked, rows, DEMO)
    parsed = F.from_json("value", "actor struct<user: struct<name: string>>, net array<struct<src_ip: string, severity: int>>, message string")
    out = out.select("doc_id", parsed.alias("d"), "n_unresolved")
    out = out.select("doc_id", "d.actor.user.name", F.col("d.net")[0]["src_ip"].alias("src_ip"), F.col("d.net")[0]["severity"].alias("severity"), F.md5(F.encode("d.message", "UTF-8")).alias("digest"), "n_unresolved")
    return out.join(left, "doc_id")


def q_vault_writers(spark, sf_dir):
    """Four writers at once assign overlapping shares of all values to one vault: what it holds at the end is what one writer would have
    written."""
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from .operators.vault_table import VaultTable
    from .shared import folder, kept

    path = f"{folder(spark)}/cloakframe-writers-{uuid.uuid4().hex}"
    found = kept(_found_values(spark, sf_dir), "found")
    share = lambda n: found.where(f"pmod(crc32(cast(value AS binary)), 4) IN ({n}, {(n + 1) % 4})")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: VaultTable(spark, path).assign(share(n), DEMO), range(4)))
    return VaultTable(spark, path).read().select("bidx", "kind", "token")


def q_json_invalid(spark, sf_dir):
    """Texts that are no JSON, or repeat a key, do not pass."""
    doc = """CASE WHEN event_id % 3 = 0 THEN '{"k":' || user_id WHEN event_id % 3 = 1 THEN '{"k":1,"k":' || user_id || '}' ELSE '{"k":' || user_id || '}' END AS doc"""
    events = table(spark, sf_dir, "events").select("event_id", F.expr(doc))
    return trees.mask_json(events, "event_id", "doc", lambda path: ("keep", None), lambda kind, v: v, invalid="null")


RESOLVE = "'address: Main VAT DE' || lpad(k, 9, '0') || ' tel: 0' || lpad(k, 9, '0')"


def q_dlp_resolved(spark, sf_dir):
    """Of findings that overlap, the one of higher priority."""
    return spans.findings(_customers(spark, sf_dir, RESOLVE + " AS text"), rules.DLP).select("c_custkey", "start", "rule", "priority", "value")


def q_dlp_field(spark, sf_dir):
    """Fields masked by what their names say, and by what is embedded in others."""
    c = _customers(spark, sf_dir, "'Ada Lovelace' AS name", "'+39 06 ' || lpad(k, 7, '0') AS phone", "'GB82WEST12345698765432' AS iban", "'s3cret-' || k AS secret", "'password: hunter2' || k AS note")
    named = {"name": "owner.contact_name", "phone": "billing.phone", "iban": "bank_iban", "secret": "api_key", "note": "remark"}
    return c.select("c_custkey", *[fields.mask_field(n, F.col(a), DEMO).alias(a) for a, n in named.items()])


def q_keep_scrub(spark, sf_dir):
    """A kept field without addresses, host names of the tenant and customer names."""
    c = _customers(spark, sf_dir, "'mail bob' || k || '@example.com from plant-' || k || ' for AcmeWater' AS remark")
    o = text.Options(host_terms=("plant-*",), client_terms=("Acme Water",), client_mode="label", client_label="<C>")
    return c.select("c_custkey", fields.scrub_kept("remark", F.col("remark"), DEMO, o).alias("remark"))


def q_person_pairs(spark, sf_dir):
    """Given and family names side by side, in either order."""
    c = _customers(spark, sf_dir, "'Dear Mario Rossi, no ' || k || ' and Bianchi, Ada' AS text")
    return c.select("c_custkey", text.mask_pairs(F.col("text"), ["mario", "ada"], ["rossi", "bianchi"], text.Maker(DEMO)).alias("text"))


def q_restore_table(spark, sf_dir):
    """A table masked column by column and restored through its vault."""
    c = _customers(spark, sf_dir, "'Owner ' || k AS owner", "'bob' || k || '@example.com' AS email", "'10.1.' || (c_custkey % 250) || '.7' AS src_ip")
    masked, _, rows = jobs.mask_table(c, DEMO, keep=("c_custkey",))
    return jobs.restore_table(masked, rows, DEMO).withColumn("c_custkey", F.col("c_custkey").cast("long"))


LINE_FORMS = {
    "cef": r"""'CEF:0|Acme|Prod|1.0|' || k || '|mail bob' || k || '@example.com|5|suser=ann' || k || ' src_ip=10.1.2.' || (c_custkey % 250) || ' msg=by eve' || k || '@example.com'""",
    "leef": r"""'LEEF:2.0|Acme|Prod|1.0|' || k || '|^|usrName=ann' || k || '^src_ip=10.1.2.' || (c_custkey % 250)""",
    "syslog": r"""'<13>Jan  1 10:00:00 srv' || k || '.corp.local app: user=ann' || k || ' src_ip=10.1.2.' || (c_custkey % 250)""",
}


def _in_clear(value):
    """Whether a masked line still has a part of ``LINE_FORMS``, but for tokens, whose letters may spell anything."""
    rest = F.regexp_replace(value, vault.TOKEN_IN_TEXT, "#")
    return rest.rlike(r"bob[0-9]|ann[0-9]+( |\^|$)|eve[0-9]+@|10\.1\.2\.|corp")


def _line_job(spark, sf_dir, fmt):
    """Lines masked by a job and restored; what was in clear must not be left in between."""
    df = _customers(spark, sf_dir, LINE_FORMS[fmt] + " AS value")
    masked, rows = jobs.mask_lines(df, fmt, DEMO)
    left = masked.select("c_custkey", _in_clear(F.col("value")).alias("in_clear"))
    return jobs.restore_lines(masked, fmt, rows, DEMO, "c_custkey").join(left, "c_custkey")


def q_cef_job(spark, sf_dir):
    return _line_job(spark, sf_dir, "cef")


def q_leef_job(spark, sf_dir):
    return _line_job(spark, sf_dir, "leef")


def q_syslog_job(spark, sf_dir):
    return _line_job(spark, sf_dir, "syslog")


def q_sweep_text(spark, sf_dir):
    """Originals that a vault knows, replaced in texts that no rule would find them in."""
    hosts = _customers(spark, sf_dir, "'fqdn' AS kind", "'w' || k || '.plant.zz' AS value").select("kind", "value")
    texts = _customers(spark, sf_dir, "'ping w' || k || '.plant.zz, then w' || k || '.plant.zzz' AS text")
    rows = vault.sealed(vault.assign(hosts, DEMO), DEMO)
    return vault.sweep_text(texts, rows, DEMO, "c_custkey")


def q_sweep_long(spark, sf_dir):
    """Originals of three and five words, in whole texts that no rule finds them in: the longest at a place wins."""
    kept_in = _customers(spark, sf_dir, "'address' AS kind", "'Old Mill Lane ' || k AS value").select("kind", "value").union(_customers(spark, sf_dir, "'address' AS kind", "'Old Mill Lane ' || k || ' Upper Town' AS value").select("kind", "value"))
    docs = spread(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")).select("doc_id", F.pmod("doc_id", F.lit(150)).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.select("doc_id", F.concat("text", F.lit(" | to OLD mill lane "), "n", F.lit(" upper town, then Old Mill Lane "), "n", F.lit(" - not Old Mill Lane-"), "n").alias("text"))
    out = vault.sweep_text(texts, vault.sealed(vault.assign(kept_in, DEMO), DEMO), DEMO, "doc_id")
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def q_pseudonymize_residuals(spark, sf_dir):
    """Documents that stay readable: secrets and phone numbers get tokens instead of a blank."""
    c = _customers(spark, sf_dir, "'password: hunter2' || k || ' tel: 0' || lpad(k, 9, '0')  AS text")
    return text.pseudonymize_residuals(c, DEMO)


def q_user_activity(spark, sf_dir):
    name = tokens.token(DEMO, "user", F.col("user_id").cast("string")).alias("user_token")
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), name)
    return e.agg(F.count("*").alias("n_events"))


def q_top_values(spark, sf_dir):
    found = _found(spark, sf_dir, "email", "ipv4").groupBy("kind", "value").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "kind", "value").limit(20)


def q_html_readable(spark, sf_dir):
    out = doc_formats.readable_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def q_text_engine(spark, sf_dir):
    """All stages over whole texts, then the residual pass."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = text.redact_residuals(text.mask_text(docs, DEMO))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def q_conversation_mask(spark, sf_dir):
    """Turns with customer names replaced in any spacing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stage = rules.client_terms(["Acme Water Group", "of the"])
    out = text.run_stage(F.col("text"), stage, lambda x: text.hidden(x, DEMO, text.Options(client_mode="label", client_label="<client>"), stage))
    return c.select("conv_id", "turn", out.alias("text"))


SQL = {
    "q_detect_email": f"WITH {_MAILS} SELECT doc_id, value, count(*) AS n FROM mails GROUP BY ALL",
    "q_detect_ipv4": f"WITH {_IPS} SELECT doc_id, value, count(*) AS n FROM ips GROUP BY ALL",
    "q_detect_counts": f"WITH {_IPS}, {_MAILS} SELECT 'ipv4' AS kind, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM ips HAVING count(*) > 0 UNION ALL SELECT 'email', count(*), count(DISTINCT doc_id) FROM mails HAVING count(*) > 0",
    "q_ip_scope": f"WITH {_IPS} SELECT {_internal_sql()} AS internal, count(*) AS n, count(DISTINCT value) AS n_values FROM ips GROUP BY 1",
    "q_tenant_networks": f"WITH {_IPS} SELECT DISTINCT value, ({_NUMBER} BETWEEN {100 << 24} AND {(104 << 24) - 1} OR {_NUMBER} BETWEEN {192 << 24} AND {(208 << 24) - 1}) AS inside FROM ips",
    "q_mask_email_tokens": f"WITH {_MAILS}, s AS (SELECT DISTINCT value, {_seed(chr(39) + 'email' + chr(39), 'lower(value)')} AS h, {_seed(chr(39) + 'emaildomain' + chr(39), 'lower(split_part(value, chr(64), 2))')} AS hd FROM mails) SELECT value, {_MAIL_TOKEN} AS token FROM s",
    "q_mask_user_tokens": f"WITH s AS (SELECT user_id, count(*) AS n_events, {_seed(chr(39) + 'user' + chr(39), 'CAST(user_id AS VARCHAR)')} AS h FROM events GROUP BY user_id) SELECT user_id, n_events, 'usr-' || {_tag('h', 8)} AS token FROM s",
    "q_mask_ipv4": f"WITH {_IPS}, s AS (SELECT DISTINCT value, {_seed(chr(39) + 'ipv4' + chr(39), 'value')} AS h FROM ips), t AS (SELECT value, {_IPV4_TOKEN.format(inner=_internal_sql())} AS token FROM s) SELECT token, count(*) AS n_values, min(value) AS least FROM t GROUP BY token",
    "q_prefixed_tokens": "WITH s AS (SELECT c_custkey, "
    + ", ".join(f"{_seed(chr(39) + k + chr(39), ('lower(' + chr(39) + ('name' if k == 'phone' else 'Name ') + chr(39) + ' || CAST(c_custkey AS VARCHAR))'))} AS h_{k}" for k in ("person", "phone", "opaque", "address", "cloud", "host"))
    + " FROM customer) SELECT c_custkey, "
    + ", ".join(f"'{tokens.PREFIXED[k][0]}' || {_tag('h_' + k, tokens.PREFIXED[k][1])} AS {k}" for k in ("person", "phone", "opaque", "address", "cloud", "host"))
    + " FROM s",
    "q_blind_index": f"SELECT c_custkey, {_bidx(chr(39) + 'person' + chr(39), 'lower(c_name)')} AS bidx FROM customer",
    "q_text_elide": f"WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{EMAIL_SQL}', '[ELIDED]', 'g'), '\\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\b', '[ELIDED]', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM e",
    "q_url_parts": r"SELECT page_id, regexp_extract(url, '^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2) AS host, regexp_extract(url, '^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS path, regexp_extract(url, '^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4) AS query, regexp_extract(url, '^(https?)://([^/:?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 5) AS fragment FROM pages",
    "q_url_sanitise": r"SELECT page_id, regexp_replace(url, '([?&#])(ref|index|token|key|code|state|session|url|next|target)=[^&#]+', '\1\2=[ELIDED]', 'g') AS url FROM pages",
    "q_json_flatten": "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "q_json_redact": "SELECT event_id, regexp_replace(replace(props, ' ', ''), '(\"k\":)[^,}]*', '\\1\"[ELIDED]\"') AS props FROM events",
    "q_sniff_profile": "WITH t AS (SELECT 'u' || user_id || '@example.com' AS contact, '10.0.0.' || (user_id % 300) AS address_seen, 'srv' || user_id || '.corp.local' AS where_seen, event_type AS what, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS maybe, user_id FROM events) "
    "SELECT 'contact' AS \"column\", count(*) AS n_filled, 'email' AS kind, count(*) AS n_kind, 0::BIGINT AS n_long FROM t UNION ALL SELECT 'address_seen', count(*), CASE WHEN count(*) FILTER (user_id % 300 <= 255) > 0 THEN 'ipv4' END, count(*) FILTER (user_id % 300 <= 255), 0 FROM t "
    "UNION ALL SELECT 'where_seen', count(*), 'fqdn', count(*), 0 FROM t UNION ALL SELECT 'what', count(*), NULL, 0, 0 FROM t UNION ALL SELECT 'maybe', count(maybe), NULL, 0, 0 FROM t",
    "q_column_policy": f"WITH s AS (SELECT *, {_seed(chr(39) + 'person' + chr(39), 'lower(c_name)')} AS h FROM customer) SELECT c_custkey, 'person-' || {_tag('h', 12)} AS c_name, c_nationkey, CASE WHEN c_acctbal IS NOT NULL THEN '[ELIDED]' END AS c_acctbal, '' AS c_mktsegment FROM s",
    "q_cell_lists": f"WITH e AS (SELECT event_id, '10.1.1.' || (user_id % 200) AS a, '8.8.8.' || (event_id % 200) AS b FROM events), s AS (SELECT *, {_seed(chr(39) + 'ipv4' + chr(39), 'a')} AS h FROM e) SELECT event_id, '[' || {_IPV4_TOKEN.format(inner='true')} || '; ' || b || ']' AS cell FROM s",
    "q_dlp_counts": r"WITH p AS (SELECT unnest(regexp_extract_all(text, '\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}')) AS v FROM documents) SELECT 'phone' AS category, 'phone_international' AS rule, count(*) AS n, count(DISTINCT v) AS n_values FROM p HAVING count(*) > 0",
    "q_luhn": r"WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{16}\b')) AS number FROM documents) SELECT doc_id, number, list_sum([CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(number[i] AS INTEGER) > 9 THEN 2 * CAST(number[i] AS INTEGER) - 9 ELSE 2 * CAST(number[i] AS INTEGER) END ELSE CAST(number[i] AS INTEGER) END FOR i IN range(1, 17)]) % 10 = 0 AS valid FROM c",
    "q_iban_mod97": "SELECT c_custkey, CAST('32142829' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '1611' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS valid FROM customer",
    "q_vat": "WITH o AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS v FROM orders), l AS (SELECT *, list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(v[i] AS INTEGER) > 9 THEN 2 * CAST(v[i] AS INTEGER) - 9 ELSE 2 * CAST(v[i] AS INTEGER) END ELSE CAST(v[i] AS INTEGER) END FOR i IN range(1, 12)]) % 10 = 0 AS ok FROM o) SELECT o_orderkey, ok AS bare, ok AS italian, true AS german FROM l",
    "q_owned_tokens": f"WITH s AS (SELECT c_custkey, {_seed(chr(39) + 'person' + chr(39), 'lower(c_name)')} AS h FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, 'person-' || {_tag('h', 12)} AS token FROM s",
    "q_host_labels": f"WITH {_HOSTS}, d AS (SELECT DISTINCT host FROM hosts WHERE contains(host, '.')) SELECT split_part(host, '.', 1) AS label, count(*) AS n_names, CASE WHEN count(*) = 1 THEN min(host) END AS \"full\" FROM d GROUP BY 1",
    "q_host_aliases": f"WITH {_HOSTS}, d AS (SELECT DISTINCT host, split_part(host, '.', 1) AS norm FROM hosts), m AS (SELECT norm, min(host) AS host FROM d WHERE length(norm) >= 4 GROUP BY norm), s AS (SELECT norm, {_seed(chr(39) + 'fqdn' + chr(39), 'host')} AS h FROM m) SELECT {_bidx(chr(39) + 'host' + chr(39), 'norm')} AS bidx, 'host' AS kind, norm, 'host-' || {_tag('h', 8)} AS token FROM s",
    "q_sweep_known": f"WITH {_HOSTS}, d AS (SELECT DISTINCT host FROM hosts), w AS (SELECT page_id, lower(rtrim(u, '.-_')) AS word FROM (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9][A-Za-z0-9._@-]{{2,252}}')) AS u FROM pages)), x AS (SELECT page_id, host, {_seed(chr(39) + 'fqdn' + chr(39), 'host')} AS h FROM w JOIN d ON word = host) SELECT page_id, 'fqdn' AS kind, 'host-' || {_tag('h', 8)} || '.masked.local' AS token, count(*) AS n FROM x GROUP BY ALL",
    "q_reverse_roundtrip": "SELECT doc_id, md5(text) AS digest, 0::BIGINT AS n_unresolved FROM documents",
    "q_priority_finding": f"WITH {_IPS}, {_MAILS}, f AS (SELECT doc_id, 'email' AS kind, value, 100 AS r FROM mails UNION ALL SELECT doc_id, 'ipv4', value, 60 FROM ips) SELECT doc_id, kind, value FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, length(value) DESC, value) = 1",
    "q_cef_parse": "SELECT event_id, 'Acme|Co' AS vendor, event_type AS name, 'user ' || user_id AS suser, 'a=b' AS msg, true AS same FROM events",
    "q_leef_parse": "SELECT event_id, CAST(event_id AS VARCHAR) AS code, 'user ' || user_id AS user_name, 2 AS n_pairs, true AS same FROM events",
    "q_syslog_parse": "SELECT event_id, 'host' || user_id AS host, 'user ' || user_id AS user_name, true AS same FROM events",
    "q_cef_mask": f"WITH s AS (SELECT *, {_seed(chr(39) + 'user' + chr(39), (chr(39) + 'user ' + chr(39) + ' || CAST(user_id AS VARCHAR)'))} AS h FROM events) SELECT event_id, 'CEF:0|Acme\\|Co|Prod|1.0|' || event_id || '|' || event_type || '|5|suser=usr-' || {_tag('h', 8)} || ' msg=a\\=b act=' || event_type AS line FROM s",
    "q_kv_transpose": "SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS user FROM events",
    "q_field_registry": "SELECT 'customer' AS source, 'c_name' AS \"column\", 'person' AS kind, 'mask' AS action, CAST(2 * count(*) AS BIGINT) AS rows_seen, CAST(2 * count(c_name) AS BIGINT) AS nonempty, CAST(2 * count(c_name) AS BIGINT) AS changed, 0::BIGINT AS elided FROM customer UNION ALL SELECT 'customer', 'c_acctbal', NULL, 'redact', CAST(2 * count(*) AS BIGINT), CAST(2 * count(c_acctbal) AS BIGINT), CAST(2 * count(c_acctbal) AS BIGINT), CAST(2 * count(c_acctbal) AS BIGINT) FROM customer",
    "q_gate_residuals": r"WITH p AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}')) AS v FROM documents) SELECT source, count(*) AS n_residual, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY source",
    "q_user_activity": f"WITH g AS (SELECT date_trunc('day', ts) AS day, user_id, count(*) AS n_events, {_seed(chr(39) + 'user' + chr(39), 'CAST(user_id AS VARCHAR)')} AS h FROM events GROUP BY ALL) SELECT day::TIMESTAMP AS day, 'usr-' || {_tag('h', 8)} AS user_token, n_events FROM g",
    "q_top_values": f"WITH {_IPS}, {_MAILS}, f AS (SELECT 'email' AS kind, value FROM mails UNION ALL SELECT 'ipv4', value FROM ips) SELECT kind, value, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, kind, value LIMIT 20",
    "q_conversation_mask": r"SELECT conv_id, turn, regexp_replace(text, '(^|[^A-Za-z0-9])of[\s_.-]{0,4}the\b', '\1<client>', 'gi') AS text FROM conversations",
}



SQL["q_vault_stats"] = f"WITH {_IPS}, {_MAILS}, f AS (SELECT 'email' AS kind, lower(value) AS norm FROM mails UNION ALL SELECT 'ipv4', value FROM ips UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events) SELECT kind, count(DISTINCT norm) AS n_values, count(*) AS n_hits FROM f GROUP BY kind"
SQL["q_vault_insert_missing"] = f"WITH {_IPS}, {_MAILS}, f AS (SELECT 'email' AS kind, lower(value) AS norm FROM mails UNION ALL SELECT 'ipv4', value FROM ips UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 <> 0) SELECT kind, count(DISTINCT norm) AS n_new, count(*) AS n_hits FROM f GROUP BY kind"
SQL["q_vault_assign"] = (
    f"WITH {_IPS}, {_MAILS}, m AS (SELECT lower(value) AS norm, count(*) AS hits FROM mails GROUP BY 1), i AS (SELECT value, count(*) AS hits FROM ips GROUP BY 1), u AS (SELECT CAST(user_id AS VARCHAR) AS norm, count(*) AS hits FROM events GROUP BY 1), "
    f"ms AS (SELECT norm, hits, {_seed(chr(39) + 'email' + chr(39), 'norm')} AS h, {_seed(chr(39) + 'emaildomain' + chr(39), 'split_part(norm, chr(64), 2)')} AS hd FROM m), \"is\" AS (SELECT value, hits, {_seed(chr(39) + 'ipv4' + chr(39), 'value')} AS h FROM i), us AS (SELECT norm, hits, {_seed(chr(39) + 'user' + chr(39), 'norm')} AS h FROM u) "
    f"SELECT {_bidx(chr(39) + 'email' + chr(39), 'norm')} AS bidx, 'email' AS kind, norm, hits, {_MAIL_TOKEN} AS token FROM ms UNION ALL "
    f"SELECT {_bidx(chr(39) + 'ipv4' + chr(39), 'value')}, 'ipv4', value, hits, {_IPV4_TOKEN.format(inner=_internal_sql())} FROM \"is\" UNION ALL "
    f"SELECT {_bidx(chr(39) + 'user' + chr(39), 'norm')}, 'user', norm, hits, 'usr-' || {_tag('h', 8)} FROM us"
)

_K = "t AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)"
_kind = lambda kind, norm: _seed(f"'{kind}'", norm)
SQL["q_many_addresses"] = f"WITH t AS (SELECT *, {ADDRESSES} AS text FROM customer) SELECT c_custkey, md5(text) AS digest, 0::BIGINT AS n_unresolved FROM t"
SQL["q_foreign_tokens"] = f"WITH {_K} SELECT c_custkey, md5('card 02:42:ac:11:00:' || lpad(substr(k, 1, 2), 2, '0') || ' at 198.18.7.' || (c_custkey % 250)) AS digest, 0::BIGINT AS n_unresolved, false AS in_clear FROM t"
SQL["q_json_mask_nested"] = f"""WITH s AS (SELECT event_id, {_kind('user', "'u' || user_id")} AS h FROM events) SELECT event_id, '{{"a":{{"b":[{{"user":{{"name":"usr-' || {_tag('h', 8)} || '"}}}},{{"n":"[ELIDED]","d":{{"e":{{"f":{{"g":{{"h":{{"i":{{"j":"[ELIDED]"}}}}}}}}}}}}}}]}},"ok":true}}' AS doc FROM s"""
SQL["q_json_invalid"] = """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{"k":' || user_id || '}' END AS doc FROM events"""
SQL["q_dlp_resolved"] = f"WITH {_K} SELECT c_custkey, 18 AS start, 'vat' AS rule, 92 AS priority, 'DE' || lpad(k, 9, '0') AS value FROM t UNION ALL SELECT c_custkey, 35, 'phone', 90, '0' || lpad(k, 9, '0') FROM t"
SQL["q_dlp_field"] = (
    f"WITH {_K}, s AS (SELECT *, {_kind('person', chr(39) + 'ada lovelace' + chr(39))} AS hn, {_kind('phone', chr(39) + '+3906' + chr(39) + ' || lpad(k, 7, ' + chr(39) + '0' + chr(39) + ')')} AS hp, {_kind('iban', chr(39) + 'gb82west12345698765432' + chr(39))} AS hi FROM t) "
    f"SELECT c_custkey, 'person-' || {_tag('hn', 12)} AS name, 'tel-' || {_tag('hp', 12)} AS phone, 'iban-' || {_tag('hi', 12)} AS iban, '[ELIDED]' AS secret, 'password: [ELIDED]' AS note FROM s"
)
SQL["q_keep_scrub"] = (
    f"WITH {_K}, s AS (SELECT *, {_kind('email', chr(39) + 'bob' + chr(39) + ' || k || ' + chr(39) + '@example.com' + chr(39))} AS h, {_kind('emaildomain', chr(39) + 'example.com' + chr(39))} AS hd, {_kind('host', chr(39) + 'plant-' + chr(39) + ' || k')} AS hh FROM t) "
    f"SELECT c_custkey, 'mail ' || {_MAIL_TOKEN} || ' from host-' || {_tag('hh', 8)} || ' for <C>' AS remark FROM s"
)
SQL["q_person_pairs"] = f"WITH {_K}, s AS (SELECT *, {_kind('person', chr(39) + 'mario rossi' + chr(39))} AS h1, {_kind('person', chr(39) + 'bianchi, ada' + chr(39))} AS h2 FROM t) SELECT c_custkey, 'Dear person-' || {_tag('h1', 12)} || ', no ' || k || ' and person-' || {_tag('h2', 12)} AS text FROM s"
SQL["q_columns_fail_closed"] = "SELECT c_custkey, " + ", ".join(f"'[ELIDED]' AS {n}" for n in CLOSED) + ", 'high' AS severity, c_custkey AS event_count FROM customer"
_SQL_ACCOUNT = "lpad(CAST(doc_id AS VARCHAR), 14, '0')"
SQL["q_iban_prose"] = (
    f"WITH d AS (SELECT doc_id, 'gb' || lpad(CAST(98 - CAST('32142829' || {_SQL_ACCOUNT} || '161100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || 'west' || {_SQL_ACCOUNT} AS norm FROM documents), s AS (SELECT doc_id, {_kind('iban', 'norm')} AS h FROM d) "
    f"SELECT doc_id, 'iban-' || {_tag('h', 12)} AS tokens, 1::BIGINT AS n_gate FROM s"
)
SQL["q_json_roundtrip"] = "SELECT doc_id, 'usr' || doc_id AS name, '10.1.' || (doc_id % 250) || '.7' AS src_ip, 6 AS severity, md5(text) AS digest, 0::BIGINT AS n_unresolved, false AS in_clear FROM documents"
SQL["q_nested_kits"] = (
    "WITH p(g, j, kit, form, w) AS (VALUES " + ", ".join(f"({g}, {j}, '{k}', '{f}', {w}::DOUBLE)" for g, j, k, f, w in SOURCES) + f"), t AS (SELECT kit, least({classify.ENOUGH}, sum(w) / 3) AS least FROM p GROUP BY kit), "
    f"d AS (SELECT g, j, count(*) OVER (PARTITION BY g) AS size, form FROM p UNION ALL VALUES ({len(KITS)}, 0, 1, 'some.thing'), ({len(KITS) + 1}, 0, 1, '{SOURCES[0][3]}')), "
    f"seen AS (SELECT DISTINCT g, form FROM d JOIN customer ON c_custkey % {len(KITS) + 2} = g AND (c_custkey // {len(KITS) + 2}) % size = j), x AS (SELECT g, string_split(form, '.') AS s FROM seen), "
    "f AS (SELECT DISTINCT g, unnest(list_concat(s, [array_to_string(s[1:i], '.') for i in range(1, len(s) + 1)])) AS form FROM x), m AS (SELECT f.g, kit, sum(w) AS weight, count(*) AS n FROM f JOIN p USING (form) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER o AS rank, coalesce(lead(weight) OVER o, 0) AS second FROM m JOIN t USING (kit) WINDOW o AS (PARTITION BY g ORDER BY weight DESC, n DESC, kit DESC)) "
    "SELECT s.g AS source, CASE WHEN n >= 2 AND weight >= least THEN kit END AS kit, round(CASE WHEN n >= 2 AND weight >= least THEN weight / (weight + second + 1) ELSE 0 END, 6) AS confidence, coalesce(n, 0)::BIGINT AS n_prints, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT g FROM seen) s LEFT JOIN r ON r.g = s.g AND rank = 1"
)
SQL["q_vault_writers"] = f"SELECT bidx, kind, token FROM ({SQL['q_vault_assign']})"
SQL["q_sql_functions"] = (
    f"WITH s AS (SELECT c_custkey, {_kind('email', chr(39) + 'bob' + chr(39) + ' || c_custkey || ' + chr(39) + '@example.com' + chr(39))} AS h, {_kind('emaildomain', chr(39) + 'example.com' + chr(39))} AS hd, {_kind('ipv4', chr(39) + '10.1.' + chr(39) + ' || (c_custkey % 250) || ' + chr(39) + '.9' + chr(39))} AS hi, "
    f"{_kind('ipv4', chr(39) + '8.8.' + chr(39) + ' || (c_custkey % 250) || ' + chr(39) + '.9' + chr(39))} AS ho, {_kind('phone', chr(39) + '+3906' + chr(39) + ' || c_custkey')} AS hp FROM customer) SELECT c_custkey, {_MAIL_TOKEN} AS mail, {_IPV4_TOKEN.format(inner='true').replace('(h,', '(hi,')} AS inner_ip, "
    f"{_IPV4_TOKEN.format(inner='false').replace('(h,', '(ho,')} AS outer_ip, 'tel-' || {_tag('hp', 12)} AS phone, {_bidx(chr(39) + 'email' + chr(39), chr(39) + 'bob' + chr(39) + ' || c_custkey || ' + chr(39) + '@example.com' + chr(39))} AS bidx, true AS own FROM s"
)
SQL["q_scan_samples"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", v AS value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '' ORDER BY v LIMIT 10)"
    for t, cs in (("customer", "c_custkey c_name c_nationkey c_mktsegment"), ("nation", "n_nationkey n_name n_regionkey"), ("region", "r_regionkey r_name")) for c in cs.split()
)
SQL["q_subnet_mask"] = "WITH t AS (SELECT c_custkey, '10.1.' || (c_custkey % 60) || '.' || (c_custkey % 250) || ' and 10.1.' || (c_custkey % 60) || '.' || (c_custkey % 240 + 1) || ' or 10.2.' || (c_custkey % 60) || '.7' AS text FROM customer) SELECT c_custkey, md5(text) AS digest, 0::BIGINT AS n_unresolved, true AS together, true AS apart, true AS hidden FROM t"
SQL["q_person_tables"] = (
    f"WITH d AS (SELECT doc_id, translate(CAST(doc_id % 100 AS VARCHAR), '0123456789', 'abcdefghij') AS n, doc_id % 100 AS k FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT d.*, c_custkey, {_kind('person', chr(39) + 'mar' + chr(39) + ' || n || ' + chr(39) + ' ross' + chr(39) + ' || n')} AS h FROM d LEFT JOIN customer ON c_custkey = k) "
    f"SELECT doc_id, md5('by ' || CASE WHEN c_custkey IS NULL THEN 'Mar' || n || ' Ross' || n ELSE 'person-' || {_tag('h', 12)} END || ', not Mar' || n || ' Bianchi') AS digest FROM s"
)
SQL["q_url_known_hosts"] = f"WITH {_HOSTS}, k AS (SELECT DISTINCT host FROM hosts WHERE page_id % 2 = 0), s AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]*)', 1) AS shown, k.host AS known, {_kind('fqdn', 'hosts.host')} AS h FROM hosts JOIN pages USING (page_id) LEFT JOIN k ON k.host = hosts.host) SELECT page_id, CASE WHEN known IS NULL THEN shown ELSE 'host-' || {_tag('h', 8)} || '.masked.local' END AS first, 'www.unknown.example' AS second FROM s"
SQL["q_restore_table"] = f"WITH {_K} SELECT c_custkey, 'Owner ' || k AS owner, 'bob' || k || '@example.com' AS email, '10.1.' || (c_custkey % 250) || '.7' AS src_ip, 0::BIGINT AS n_unresolved FROM t"
SQL |= {f"q_{fmt}_job": f"WITH {_K} SELECT c_custkey, {line} AS value, 0::BIGINT AS n_unresolved, false AS in_clear FROM t" for fmt, line in LINE_FORMS.items()}
SQL["q_sweep_text"] = f"WITH {_K}, s AS (SELECT *, {_kind('fqdn', chr(39) + 'w' + chr(39) + ' || k || ' + chr(39) + '.plant.zz' + chr(39))} AS h FROM t) SELECT c_custkey, 'ping host-' || {_tag('h', 8)} || '.masked.local, then w' || k || '.plant.zzz' AS text FROM s"
SQL["q_sweep_long"] = (
    f"WITH {_K}, s AS (SELECT c_custkey, {_kind('address', chr(39) + 'old mill lane ' + chr(39) + ' || k')} AS h1, {_kind('address', chr(39) + 'old mill lane ' + chr(39) + ' || k || ' + chr(39) + ' upper town' + chr(39))} AS h2 FROM t), d AS (SELECT doc_id, doc_id % 150 AS n, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL) "
    f"SELECT doc_id, md5(text || ' | to ' || coalesce('addr-' || {_tag('h2', 12)}, 'OLD mill lane ' || n || ' upper town') || ', then ' || coalesce('addr-' || {_tag('h1', 12)}, 'Old Mill Lane ' || n) || ' - not Old Mill Lane-' || n) AS digest FROM d LEFT JOIN s ON c_custkey = n"
)
SQL["q_pseudonymize_residuals"] = f"WITH {_K}, s AS (SELECT *, {_kind('secret', chr(39) + 'hunter2' + chr(39) + ' || k')} AS h, {_kind('phone', chr(39) + '0' + chr(39) + ' || lpad(k, 9, ' + chr(39) + '0' + chr(39) + ')')} AS hp FROM t) SELECT c_custkey, 'password: secret-' || {_tag('h', 12)} || ' tel: tel-' || {_tag('hp', 12)} AS text FROM s"
SQL["q_subnet_tokens"] = (
    f"WITH v AS (SELECT DISTINCT '10.0.' || (user_id % 40) AS net, '10.0.' || (user_id % 40) || '.' || (event_id % 50) AS value FROM events), n AS (SELECT net, row_number() OVER (ORDER BY {_kind('ipv4net', 'net')}) - 1 AS a FROM (SELECT DISTINCT net FROM v)), "
    f"h AS (SELECT net, value, row_number() OVER (PARTITION BY net ORDER BY {_kind('ipv4host', 'value')}) - 1 AS b FROM v) SELECT value, '198.18.' || a || '.' || b AS token FROM h JOIN n USING (net)"
)

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")} | rule_queries.QUERIES
SQL |= rule_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection over whole texts, validated, tokenised and counted by kind."""
    found = _found(spark, sf_dir, "email", "ipv4", "mac", "fqdn")
    return vault.values(found.select("kind", "value"), DEMO).groupBy("kind").agg(F.count("*").alias("n_values"), F.sum("hits").alias("n_findings"))
