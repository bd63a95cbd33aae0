"""What a text holds of a long list, found by joins: listed names of people, hosts that the vault knows.

The list may be of any length: the distinct words of the texts meet it by hash, with the list broadcast only if it
is counted to be short.  A text is known by a digest, so equal texts are looked up once and no id is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.tokens import Keys
from ..shared import free_names

BROADCAST_ROWS = 500_000
NAME = r"\p{Lu}[\p{L}']+"


def _with_met(df: DataFrame, text: str, words: Column, listed: DataFrame, groups: dict[str, Column], rows: int) -> DataFrame:
    """``df`` with arrays of the words that ``listed`` (word, ...) has, one for each of ``groups`` (condition)."""
    (key,) = free_names(df, "lookup")
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    seen = keyed.select(key, F.explode(F.array_distinct(words)).alias("word"))
    met = seen.join(F.broadcast(listed) if listed.count() <= rows else listed, "word")
    met = met.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(test, F.col("word")))).alias(name) for name, test in groups.items()])
    out = keyed.join(met, key, "left").drop(key)
    return out.withColumns({name: F.coalesce(F.col(name), F.array().cast("array<string>")) for name in groups})


def with_names(df: DataFrame, names: DataFrame, text: str, given: str, family: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the columns ``given`` and ``family``: the names of the table (name, role) that stand in a text, capitalised, beside another
    capitalised word."""
    beside = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"({NAME}+(?:(?:[ \t]{{1,3}}|, ?|[._-]){NAME}+)+)"))
    words = F.transform(F.regexp_extract_all(F.array_join(beside, "\n"), F.lit(f"({NAME})")), lambda w: F.lower(w))
    listed = names.select(F.lower("name").alias("word"), "role").distinct()
    return _with_met(df, text, words, listed, {given: F.col("role") == "given", family: F.col("role") == "family"}, rows)


def with_known_hosts(df: DataFrame, vault: DataFrame, keys: Keys, text: str, hosts: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the column ``hosts``: the hosts of a text's URLs that the vault knows."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?i)https?://(?:[^/@?#\s]*@)?([^/:?#\s\"'<>]+)"))
    words = F.transform(found, lambda h: F.lower(F.rtrim(h, F.lit(".,;!)"))))
    seen = df.select(F.explode(F.array_distinct(words)).alias("word")).distinct().withColumn("bidx", tokens.blind_index(keys, "fqdn", F.col("word")))
    known = seen.join(vault.where("kind = 'fqdn'").select("bidx"), "bidx", "left_semi").select("word")
    return _with_met(df, text, words, known, {hosts: F.lit(True)}, rows)
