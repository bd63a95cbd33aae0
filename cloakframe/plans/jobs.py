"""Jobs: presets, masking a table end to end, restoring it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.tokens import Keys
from ..operators import classify, gate, lookups, nested, text, vault
from ..operators.vault_table import Busy, VaultTable
from ..shared import discard, free_names, kept
from ..sources import lines, trees

#: Option bundles by use.
PROFILES: dict[str, dict] = {
    "logs": {},
    "incident": {"ip_mode": "internal", "url_mode": "internal"},
    "sharing": {"client_mode": "label"},
    "documents": {"client_mode": "pseudonymize", "keep_domain": False, "residuals": "pseudonymize"},
    "hunting": {"ip_mode": "none", "url_mode": "none"},
}


def options(profile: str = "logs", **changes) -> text.Options:
    if "dlp" in changes:
        changes["dlp"] = rules.policy(changes["dlp"])
    return replace(text.Options(**PROFILES[profile]), **changes)


def _pairs(df: DataFrame, *others: str) -> DataFrame:
    """(others, kind, value): what the column ``_made`` recorded."""
    cut = df.select(*others, F.explode("_made").alias("x"))
    return cut.select(*others, F.substring_index("x", "|", 1).alias("kind"), F.expr("substr(x, instr(x, '|') + 1)").alias("value"))


def _recorded(df: DataFrame) -> DataFrame:
    return df.withColumn("_made", F.array().cast("array<string>"))


def all_findings(df: DataFrame, o: text.Options, column: str = "text", keys: Keys = Keys(bytes(32))) -> DataFrame:
    """(kind, value) of every token that masking the texts with all stages makes, for the vault: hosts and
    identifiers in URLs and the parts of accounts included.  A value that embeds the token of an earlier
    stage is the one of these ``keys``.  What the stages recorded is written first: a filter on it, which exploding implies, would
    be pushed down through all stages and repeat their expressions."""
    return _pairs(kept(text.mask_text(_recorded(df), keys, o, column, "_made").select("_made"), "recorded"))


def _with_foreign(df: DataFrame, texts: list[Column], known: DataFrame | None) -> DataFrame:
    """Adds ``_foreign``: what looks like a token in the row's texts and was not issued by the vault ``known``."""
    looks = F.array_distinct(F.flatten(F.array(*[text.looks_own(t) for t in texts])))
    if known is None:
        return df.withColumn("_foreign", looks)
    seen = df.select("_key", F.explode(looks).alias("token")).distinct()
    stem = F.explode(F.array_distinct(F.array("token", F.substring_index("token", ".", 1)))).alias("token")
    alien = kept(seen.join(known.select(stem).distinct(), "token", "left_anti").groupBy("_key").agg(F.collect_list("token").alias("_foreign")), "foreign")
    return df.join(alien, "_key", "left").withColumn("_foreign", F.coalesce("_foreign", F.array().cast("array<string>")))


def _flat(issued: DataFrame) -> DataFrame:
    return issued.select("_key", F.explode("_issued"))


Run = Callable[[DataFrame, text.Maker], DataFrame]
#: Keys of rows that are counted to be so few are broadcast; with more, the tables are shuffled.
FEW_KEYS = 200_000


def _through_vault(df: DataFrame, keys: Keys, o: text.Options, columns: list[str], run: Run, known: DataFrame | None, texts: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked table, new vault rows).  ``run`` masks and records in ``_made``; the first time with unsalted
    tokens, then, for rows that have a value with another one, with those of the vault, until no token
    changes: later stages see tokens that earlier ones wrote, so it ends after as many times as there are
    stages, and after one where no value is salted.  If masking rows anew records what it did before, the vault
    stays as it is and is not made again.  Where few rows are masked anew, only they are written.  ``texts`` is what may hold values that
    look like tokens (the columns)."""
    source = _recorded(df).withColumn("_key", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256))
    source = _with_foreign(source, texts or [F.col(f"`{c}`").cast("string") for c in columns], known)
    done, before = kept(run(source, text.Maker(keys, None, F.col("_foreign"))), "masked"), None
    for _ in range(len(text.stages(o)) + 2):
        found = _pairs(done, "_key")
        rows = vault.assign(found.select("kind", "value"), keys, known, o.keep_scope, o.keep_domain, o.keep_subnets)
        if known is None:
            other = vault.moved(rows, keys, o.keep_scope, o.keep_domain, o.keep_subnets)
        else:
            other = vault.moved_among(found, rows.select("bidx", "token").union(known.select("bidx", "token")), keys, o.keep_scope, o.keep_domain)
        other = kept(other, "moved")
        if before is None and other.isEmpty():
            return done.drop("_made", "_key"), rows
        issued = kept(vault.issued(found, other, "_key"), "issued")
        if before is not None and _flat(before).exceptAll(_flat(issued)).isEmpty() and _flat(issued).exceptAll(_flat(before)).isEmpty():
            return done.drop("_made", "_key"), rows
        touched = kept(issued.select("_key") if before is None else issued.select("_key").union(before.select("_key")).distinct(), "touched")
        few = touched.count() <= FEW_KEYS
        touched = F.broadcast(touched) if few else touched
        again = run(source.join(touched, "_key", "left_semi").join(issued, "_key", "left"), text.Maker(keys, F.col("_issued"), F.col("_foreign"))).select(*[f"`{c}`" for c in done.columns])
        after = done.join(touched, "_key", "left_anti").unionByName(kept(again, "masked") if few else again)
        after = after if few else kept(after, "masked")
        made = lambda x: x.select("_key", "_made").join(touched, "_key", "left_semi")
        if made(after).exceptAll(made(done)).isEmpty():  # as many rows as before
            return after.drop("_made", "_key"), rows
        done, before = after, issued
    raise RuntimeError("the tokens of the vault do not settle")


def mask_known(df: DataFrame, keys: Keys, o: text.Options = text.Options(), column: str = "text", known: DataFrame | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked table, new rows of the vault ``known``): every value has the token that the vault has for it.  ``names`` (name, role) is a table of given
    and family names, of any length; hosts that the vault knows are masked in URLs even where others stay."""
    source, given, family, hosts = df, *free_names(df, "given", "family", "hosts")
    if names is not None:
        source, o = lookups.with_names(source, names, column, given, family), replace(o, given_column=given, family_column=family)
    if known is not None and o.url_mode == "internal":
        source, o = lookups.with_known_hosts(source, known, keys, column, hosts), replace(o, hosts_column=hosts)

    def run(x: DataFrame, make: text.Maker) -> DataFrame:
        out = text.mask_text(x, make, o, column, "_made")
        if o.residuals == "pseudonymize":
            out = text.pseudonymize_residuals(out, make, o, column, "_made")
        return out.select(*[f"`{n}`" for n in (*df.columns, "_made", "_key")])

    return _through_vault(source, keys, o, [column], run, known)


def mask(df: DataFrame, keys: Keys, o: text.Options = text.Options(), column: str = "text", safe: bool = True, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked table, vault rows): text masked by all stages with the tokens of the vault; residual personal
    data gets tokens if the options say so, and what is left of it is elided if ``safe``."""
    masked, rows = mask_known(df, keys, o, column, names=names)
    if safe:
        masked = text.redact_residuals(masked, o, column)
    return masked, vault.sealed(rows, keys)


def scan(df: DataFrame, policy_path: str | None = None, force: bool = False, dry_run: bool = False, k: int = 10, **config) -> DataFrame:
    """(column, kind, action, decided_by, samples): what is to be done with each column and its k least values.  The plan is
    written to ``policy_path`` as an editable JSON document, which is never overwritten unless forced; a dry run writes nothing."""
    kit = config.get("kit") or classify.detect_kit(df.columns)[0]
    decisions = classify.plan(df, **config)
    if policy_path and not dry_run:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(policy_path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if force or not fs.exists(target):
            plain = fs.getRawFileSystem() if fs.getScheme() == "file" else fs  # no checksum beside a file that is to be edited
            out = plain.create(target, True)
            out.write(json.dumps(classify.policy_document(decisions, kit), indent=2).encode())
            out.close()
    rows = [(i, d.column, d.kind, d.action, d.by) for i, d in enumerate(decisions)]
    plan = df.sparkSession.createDataFrame(rows, "n int, column string, kind string, action string, decided_by string")
    few = classify.samples(df, k).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return plan.join(few, "column", "left").orderBy("n").drop("n")


def load_policy(spark, path: str) -> dict[str, tuple[str, str | None]]:
    """The overrides of a policy document that ``scan`` wrote, for ``mask_table(overrides=...)``."""
    lines_ = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]  # one small document
    return classify.overrides_of(json.loads(lines_[0]))


def mask_table(df: DataFrame, keys: Keys, o: text.Options = text.Options(), gated: bool = True, **config) -> tuple[DataFrame, list[classify.Decision], DataFrame]:
    """(masked table, plan, vault rows): every column classified and masked by its decision, with the tokens
    of the vault.  Columns that the configuration does not keep pass the gate, or the job ends (``gated``)."""
    decisions = classify.plan(df, **config)
    masked = [d.column for d in decisions if d.action in ("mask", "text", "ioc") or (d.action == "keep" and d.by not in ("config", "override"))]
    if masked:

        def run(x: DataFrame, make: text.Maker) -> DataFrame:
            return classify.apply_plan(x, decisions, make, o, "_made", ("_key", "_foreign", *(["_issued"] if make.issued is not None else []))).drop("_issued", "_foreign")

        out, rows = _through_vault(df, keys, o, masked, run, None)
    else:
        out, rows = classify.apply_plan(df, decisions, keys, o), vault.assign(_pairs(_recorded(df)), keys)
    if gated:
        gate.require(out, o, [d.column for d in decisions if d.by not in ("config", "override") and not (d.kind or "").startswith("sid")])
    return out, decisions, vault.sealed(rows, keys)


def release_table(df: DataFrame, keys: Keys, path: str, o: text.Options = text.Options(), **config) -> tuple[gate.Verdict, DataFrame]:
    """Masks a table and writes it, or raises and writes nothing."""
    masked, decisions, rows = mask_table(df, keys, o, gated=False, **config)
    return gate.release(masked, path, o, [d.column for d in decisions if d.by not in ("config", "override")], rows), rows


def release(df: DataFrame, keys: Keys, path: str, o: text.Options = text.Options(), column: str = "text") -> tuple[gate.Verdict, DataFrame]:
    """Masks and writes, or raises and writes nothing; gives the verdict and the vault rows that restore what was written."""
    masked, rows = mask(df, keys, o, column)
    return gate.release(masked, path, o, column, rows), rows


def restore_table(df: DataFrame, rows: DataFrame, keys: Keys, columns: list[str] | None = None) -> DataFrame:
    """``df`` with the tokens in its columns (all text columns) restored, and n_unresolved: the tokens of all columns of a
    row are restored by one join and go back by one grouping."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    (row,) = free_names(df, "row")
    out = vault.restore(df.drop("n_unresolved").withColumn(row, F.monotonically_increasing_id()), rows, keys, row, names)
    return out.select(*[f"`{n}`" for n in df.columns if n != "n_unresolved"], "n_unresolved")


def restore_header(columns: list[str], rows: DataFrame, keys: Keys) -> list[str]:
    """Column names with their tokens restored."""
    named = rows.sparkSession.createDataFrame(list(enumerate(columns)), "n int, text string")
    return [r["text"] for r in vault.restore(named, rows, keys, "n").orderBy("n").collect()]


def mask_lines(df: DataFrame, fmt: str, keys: Keys, o: text.Options = text.Options(), column: str = "value", keep: tuple[str, ...] = (), invalid: str = "raise", by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked table, vault rows) of CEF, LEEF or key=value syslog lines: each pair's value is masked by what its key is classified
    as, the event name of CEF and the prefix of syslog as free text, other header fields stay.  A line that is not of the
    format ends the job, or becomes null if ``invalid`` is "null".  With ``by`` every source named by that column gets the rules of
    the kit that its keys tell."""
    parse, _ = lines.PARSERS[fmt]
    found = nested.with_kits(df, column, fmt, by, "_kit") if by else df.withColumn("_kit", F.lit(None).cast("string"))
    found = found.withColumn("_record", parse(F.col(column)))
    told = nested.decisions(F.col("_record.pairs.key"), F.col("_kit"), partial(_pair, keep=keep))
    parsed = kept(found.withColumn("_told", told).drop("_kit"), "lines")
    bad = parsed.where(F.col("_record").isNull() & F.col(column).isNotNull())
    if invalid == "raise" and not bad.isEmpty():
        raise ValueError(f"a line is no {fmt} record")
    kinds = [r["kind"] for r in parsed.select(F.explode("_told").alias("x")).where("x.action = 'mask'").select("x.kind").distinct().collect()]  # those that masks know

    def run(x: DataFrame, make: text.Maker) -> DataFrame:
        return _lines_masked(x, fmt, make, o, column, sorted(kinds))

    out, rows = _through_vault(parsed, keys, o, [column], run, None)
    return out, vault.sealed(rows, keys)


def _pair(key: str, kit: str | None, keep: tuple[str, ...]) -> tuple[str, str | None]:
    """What is to be done with a pair by its key; what no rule knows is elided."""
    d = classify.decide(key, None, kit, keep=keep)
    if d.action == "keep" and d.by == "unclassified":
        return "redact", None
    return ("text", None) if d.action == "ioc" else (d.action, d.kind)


def _lines_masked(x: DataFrame, fmt: str, make: text.Maker, o: text.Options, column: str, kinds: list[str]) -> DataFrame:
    _, render = lines.PARSERS[fmt]
    notes = text.noting(make)

    def value(v, told):
        out = F.when(told["action"].isin("keep", "text") | ~classify.filled(v), v)
        for kind in kinds:
            out = out.when((told["action"] == "mask") & (told["kind"] == kind), classify.masked_cell(kind, v, notes, o))
        return out.otherwise(text.ELIDED)

    free = F.transform("_told", lambda t: t["action"] == "text")
    masked = F.transform("_record.pairs", lambda p, i: p.withField("value", value(p["value"], F.get("_told", i))))
    out = x.withColumn("_record", F.when(F.col("_record").isNotNull(), F.col("_record").withField("pairs", masked))).withColumn("_told", free)
    out = out.withColumn("_made", F.concat("_made", F.coalesce(text.noted(F.array_join(F.transform("_record.pairs", lambda p: p["value"]), "")), F.array().cast("array<string>"))))
    out = out.withColumn("_record", lines.transform_pairs(F.col("_record"), lambda k, v: text.plain(v)))
    # free text of the record: the name of the event, the prefix, and message fields, masked as one text with separators
    pick = F.filter("_record.pairs", lambda p, i: F.get("_told", i))
    head = F.when(F.size("_record.header") > 5, F.get("_record.header", F.lit(5))).otherwise("")
    joined = F.concat_ws("\n\x04\n", head, F.col("_record.prefix"), F.transform(pick, lambda p: p["value"]))
    out = text.mask_text(out.withColumn("_free", joined), make, o, "_free", "_made")
    cut = F.split("_free", "\n\x04\n")
    header = F.transform("_record.header", lambda h, i: F.when((i == 5) & (F.size("_record.header") > 5), F.get(cut, F.lit(0))).otherwise(h))
    at = lambda i: F.size(F.filter(F.slice("_told", 1, i), lambda t: t))
    pairs = F.transform("_record.pairs", lambda p, i: F.when(F.get("_told", i), p.withField("value", F.get(cut, at(i) + 2))).otherwise(p))
    record = F.when(F.col("_record").isNotNull(), F.col("_record").withField("header", header).withField("prefix", F.get(cut, F.lit(1))).withField("pairs", pairs))
    return out.withColumn(column, render(record)).drop("_record", "_told", "_free", "_foreign", "_issued")


def restore_lines(df: DataFrame, fmt: str, rows: DataFrame, keys: Keys, id_col: str, column: str = "value") -> DataFrame:
    """Lines with the tokens in their values, headers and prefixes restored, and n_unresolved: tokens need no escaping, and
    originals are escaped again as the format asks, so the line is parsed, restored part by part, and rendered."""
    parse, render = lines.PARSERS[fmt]
    parts = df.select(id_col, parse(F.col(column)).alias("_record"))
    texts = F.concat(F.array("_record.prefix"), "_record.header", F.transform("_record.pairs", lambda p: p["value"]))
    cells = parts.select(id_col, F.posexplode(texts).alias("_at", "text")).withColumn("_cell", F.concat_ws("|", F.col(id_col).cast("string"), "_at"))
    done = vault.restore(cells, rows, keys, "_cell").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_at", "text"))).alias("_texts"), F.sum("n_unresolved").alias("n_unresolved"))
    n = F.size("_record.header")
    header = F.transform("_record.header", lambda h, i: F.col("_texts")[i + 1])
    pairs = F.transform("_record.pairs", lambda p, i: p.withField("value", F.col("_texts")[i + n + 1]))
    record = F.col("_record").withField("prefix", F.col("_texts")[F.lit(0)]).withField("header", header).withField("pairs", pairs)
    return df.drop(column).join(parts.join(done, id_col).select(id_col, render(record).alias(column), "n_unresolved"), id_col, "left")


LEAF_BREAK = "\n\x04\n"  # between texts that are masked or restored as one


def _leaf(path: str, found: str | None = None, *, keep: tuple[str, ...], overrides: dict, kit: str | None) -> tuple[str, str | None]:
    """What is to be done with a leaf by its path and the kit found for its source; what no rule knows is elided."""
    d = classify.decide(path, None, found or kit, keep=keep, overrides=overrides)
    return ("redact", None) if d.by == "unclassified" else ("text", None) if d.action == "ioc" else (d.action, d.kind)


def mask_json(df: DataFrame, keys: Keys, o: text.Options = text.Options(), column: str = "value", keep: tuple[str, ...] = (), overrides: dict | None = None, kit: str | None = None, invalid: str = "raise", known: DataFrame | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked table, vault rows) of a column of JSON documents, or of lines of NDJSON: every leaf by what its path is classified as,
    at any depth, with the tokens of the vault.  The leaves of a document that are free text are masked as one text.  A text that is no
    JSON ends the job, or becomes null if ``invalid`` is "null"; blank lines stay.  With ``by`` every source named by that column gets
    the rules of the kit that its paths tell, or of ``kit`` if they tell none."""
    decide = partial(_leaf, keep=keep, overrides=overrides or {}, kit=kit)
    source = kept(nested.with_kits(df, column, "json", by, "_kit") if by else df, "documents")
    read = lambda x: trees.with_leaves(x, column, decide, invalid, by="_kit" if by else None).drop("_kit")
    parsed = read(source)  # parsed again by each pass: with its leaves every text would be written twice
    kinds = [r["kind"] for r in parsed.select(F.explode("_leaves").alias("x")).where("x.action = 'mask'").select("x.kind").distinct().collect()]  # those that masks know

    def run(x: DataFrame, make: text.Maker) -> DataFrame:
        return _json_masked(read(x), make, o, column, kinds)

    strings = F.regexp_replace(F.col(column), r"\\(?:u[0-9A-Fa-f]{4}|.)", " ")  # an escaped line break is no letter before what follows it
    out, rows = _through_vault(source, keys, o, [column], run, known, [strings])
    discard(source)
    return out, vault.sealed(rows, keys)


def _json_masked(x: DataFrame, make: text.Maker, o: text.Options, column: str, kinds: list[str]) -> DataFrame:
    notes, none = text.noting(make), F.array().cast("array<string>")

    def cell(leaf):
        new = F.when((leaf["action"] == "redact") & classify.filled(leaf["value"]), text.ELIDED).when(leaf["action"] == "drop", "")
        for kind in kinds:
            new = new.when((leaf["action"] == "mask") & (leaf["kind"] == kind), classify.masked_cell(kind, leaf["value"], notes, o))
        return new

    out = x.withColumn("_new", F.transform("_leaves", cell))
    out = out.withColumn("_made", F.concat("_made", F.coalesce(F.flatten(F.transform("_new", lambda v: F.coalesce(text.noted(v), none))), none)))
    texts = F.transform(F.filter("_leaves", lambda leaf: leaf["action"] == "text"), lambda leaf: F.translate(leaf["value"], "\x04", ""))
    out = text.mask_text(out.withColumn("_free", F.array_join(texts, LEAF_BREAK)), make, o, "_free", "_made")
    out = out.withColumn("_cut", F.split("_free", LEAF_BREAK))
    new = lambda leaf, i: F.when(leaf["action"] == "text", F.get("_cut", leaf["nth"])).otherwise(text.plain(F.get("_new", i)))
    changed = F.transform(F.transform("_leaves", lambda leaf, i: F.struct(leaf["value"].alias("old"), new(leaf, i).alias("new"))), lambda p: F.when(p["new"] != p["old"], p["new"]))
    out = out.withColumn("_new", F.when(F.col("_leaves").isNotNull(), changed)).drop("_free", "_cut", "_leaves", "_foreign", "_issued")
    return trees.put_back(out, column, "_new")


def restore_json(df: DataFrame, rows: DataFrame, keys: Keys, column: str = "value", invalid: str = "raise") -> DataFrame:
    """``df`` with the tokens in the strings of its JSON documents restored, and n_unresolved."""
    row, texts, hollow = free_names(df, "row", "texts", "hollow")
    parts = trees.emptied(df.drop("n_unresolved").withColumn(row, F.monotonically_increasing_id()), column, texts, hollow, invalid)
    out = vault.restore(parts.withColumn(texts, F.array_join(texts, LEAF_BREAK)), rows, keys, row, texts)
    return trees.refilled(out.withColumn(texts, F.split(texts, LEAF_BREAK)).drop(row), column, texts, hollow)


def mask_into(df: DataFrame, keys: Keys, table: VaultTable, o: text.Options = text.Options(), column: str = "text", tries: int = 64) -> tuple[DataFrame, int]:
    """(masked table, vault version): the tokens are those of a vault that others may be writing; if one of them turns out to be taken,
    the texts are masked again."""
    for _ in range(tries):
        base = table.version()
        masked, rows = mask_known(df, keys, o, column, table.read(base))
        done = table.commit(vault.sealed(rows, keys), base)
        if done is not None:
            return masked, done
    raise Busy(f"{tries} other writers were first")
