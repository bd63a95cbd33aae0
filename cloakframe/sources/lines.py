"""Line protocols as columns: CEF, LEEF and key=value syslog, parsed to struct(prefix, header, pairs,
delimiter) and rendered back, and the detection of a file's format.

``pairs`` is array<struct<key, value, quoted>>: order and repeated keys are kept.  A line that is not of
the format parses to null, which the release gate counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = r"[A-Za-z][A-Za-z0-9_.-]{0,127}"
_HIDE = (("\\\\", "\x02"), ("\\|", "\x03"), ("\\=", "\x04"))


def _hide(c: Column) -> Column:
    """Escaped characters as control characters, so that splitting is plain."""
    for old, new in _HIDE:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _show(c: Column) -> Column:
    return F.translate(c, "\x02\x03\x04", "\\|=")


def _escape(c: Column, chars: str) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def _pair(raw: Column) -> Column:
    key = F.substring_index(raw, "=", 1)
    value = F.btrim(F.substr(raw, F.length(key) + 2))
    quoted = value.rlike(r'^"[\s\S]*"$') & (F.length(value) >= 2)
    inner = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.struct(key.alias("key"), _show(F.replace(inner, F.lit('\\"'), F.lit('"'))).alias("value"), quoted.alias("quoted"))


def _spaced(c: Column) -> Column:
    """Pairs of ``key=value key=value``: a value runs to the next key."""
    return F.transform(F.filter(F.split(F.btrim(c), rf"\s+(?={KEY}=)"), lambda p: p.rlike(rf"^{KEY}=")), _pair)


def _record(header: Column, pairs: Column, prefix: Column | None = None, delimiter: Column | None = None) -> Column:
    return F.struct((F.lit("") if prefix is None else prefix).alias("prefix"), header.alias("header"), pairs.alias("pairs"), (F.lit(" ") if delimiter is None else delimiter).alias("delimiter"))


def parse_cef(line: Column) -> Column:
    """``CEF:`` with seven header fields and space-separated pairs."""
    parts = F.split(_hide(F.substr(line, F.lit(5))), r"\|", 8)
    good = line.startswith("CEF:") & (F.size(parts) == 8)
    return F.when(good, _record(F.transform(F.slice(parts, 1, 7), _show), _spaced(F.element_at(parts, 8))))


def render_cef(r: Column) -> Column:
    header = F.array_join(F.transform(r["header"], lambda h: _escape(h, "|")), "|")
    return F.concat(F.lit("CEF:"), header, F.lit("|"), F.array_join(F.transform(r["pairs"], lambda p: F.concat(p["key"], F.lit("="), _escape(p["value"], "="))), " "))


def parse_leef(line: Column) -> Column:
    """LEEF 1.0 (tab, or space if there is no tab) and 2.0 (a delimiter: tab, one character, or 0xNN)."""
    parts = F.split(_hide(F.substr(line, F.lit(6))), r"\|", 7)
    two = F.element_at(parts, 1).startswith("2") & (F.size(parts) == 7)
    given = F.get(parts, F.lit(5))
    code = F.char(F.conv(F.regexp_extract(given, "^0[xX]([0-9A-Fa-f]{1,4})$", 1), 16, 10).cast("int"))
    asked = F.when(given.isin("tab", "\t", "0x09"), "\t").when(given.rlike("^0[xX][0-9A-Fa-f]{1,4}$"), code).when(F.length(given) == 1, _show(given))
    body = F.when(two, F.get(parts, F.lit(6))).otherwise(F.array_join(F.slice(parts, 6, 9), "|"))
    delimiter = F.when(two, asked).otherwise(F.when(body.contains("\t"), "\t").otherwise(" "))
    items = F.filter(F.split(body, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))), lambda p: p != "")
    pairs = F.when(delimiter == " ", _spaced(body)).otherwise(F.transform(items, _pair))
    sound = (delimiter == " ") | F.forall(items, lambda p: p.rlike("^[^=]+="))
    return F.when(line.startswith("LEEF:") & (F.size(parts) >= 6) & delimiter.isNotNull() & sound, _record(F.transform(F.slice(parts, 1, 5), _show), pairs, None, delimiter))


def _quoted(p: Column) -> Column:
    body = _escape(p["value"], '"')
    return F.concat(p["key"], F.lit("="), F.when(p["quoted"] | body.rlike(r"\s"), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(body))


def render_leef(r: Column) -> Column:
    header = F.array_join(F.transform(r["header"], lambda h: _escape(h, "|")), "|")
    shown = F.when(r["header"][0].startswith("2"), F.concat(F.when(r["delimiter"] == "\t", "0x09").otherwise(r["delimiter"]), F.lit("|"))).otherwise("")
    plain = lambda p: F.when(p["quoted"], F.concat(p["key"], F.lit('="'), _escape(p["value"], '"'), F.lit('"'))).otherwise(F.concat(p["key"], F.lit("="), _escape(p["value"], "")))
    body = F.when(r["delimiter"] == " ", F.array_join(F.transform(r["pairs"], _quoted), " ")).otherwise(F.call_function("array_join", F.transform(r["pairs"], plain), r["delimiter"]))
    return F.concat(F.lit("LEEF:"), header, F.lit("|"), shown, body)


def parse_syslog(line: Column) -> Column:
    """A prefix and key=value pairs with nothing else between or after them."""
    one = rf'(?:{KEY})=(?:"(?:\\.|[^"\\])*"|\S+)'
    tail = F.regexp_extract(line, rf"(?:^|\s)({one}(?:\s+{one})*)\s*$", 1)
    raw = F.regexp_extract_all(tail, F.lit(rf"({one})"))
    prefix = F.rtrim(F.substr(line, F.lit(1), F.length(F.rtrim(line)) - F.length(tail)))
    stray = prefix.rlike(rf"(?:^|\s){KEY}=")
    return F.when((tail != "") & ~stray, _record(F.array().cast("array<string>"), F.transform(raw, lambda p: _pair(F.replace(p, F.lit("\\\\"), F.lit("\x02")))), prefix))


def render_syslog(r: Column) -> Column:
    return F.btrim(F.concat(r["prefix"], F.lit(" "), F.array_join(F.transform(r["pairs"], _quoted), " ")))


def syslog_host(prefix: Column) -> Column:
    """The host name in an RFC 5424 or RFC 3164 prefix, or an empty string."""
    new = F.regexp_extract(prefix, r"^<[0-9]+>[0-9]+ +\S+ +(\S+)", 1)
    old = F.regexp_extract(prefix, r"^<[0-9]+>[A-Z][a-z]{2} +[0-9]{1,2} +[0-9:]{8} +(\S+)", 1)
    return F.when(new != "", new).otherwise(old)


PARSERS = {"cef": (parse_cef, render_cef), "leef": (parse_leef, render_leef), "syslog": (parse_syslog, render_syslog)}


def detect_format(lines: DataFrame, column: str = "value") -> str | None:
    """The format of a table of lines: what all its lines are, in one aggregation."""
    c = F.col(column)
    full = c.rlike(r"\S")
    looks = F.btrim(c).rlike(r"^[\[{]")
    cases = {"cef": c.startswith("CEF:"), "leef": c.startswith("LEEF:"), "ndjson": looks & F.try_parse_json(c).isNotNull(), "json": looks, "syslog": F.size(F.coalesce(parse_syslog(c)["pairs"], F.array())) >= 2}
    row = lines.where(full).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in cases.items()]).first()
    if not row["n"]:
        return None
    if lines.where(full).first()[column].lstrip()[:1] in ("{", "["):
        return "ndjson" if row["ndjson"] == row["n"] and row["n"] > 1 else "json"
    return next((k for k in ("cef", "leef", "syslog") if row[k] == row["n"]), None)


def transform_pairs(record: Column, change) -> Column:
    """The record with ``change(key, value)`` as each pair's value."""
    return F.when(record.isNotNull(), record.withField("pairs", F.transform(record["pairs"], lambda p: p.withField("value", change(p["key"], p["value"])))))


def transpose(rows: DataFrame, id_col: str, key: str, value: str) -> DataFrame:
    """Vertical key/value rows as one row per id; values of a repeated key are joined by a comma."""
    grouped = rows.groupBy(id_col, key).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("_v"))
    return grouped.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_v").alias("value"))))).alias("fields"))
