"""Vendor kits of nested documents and of lines, for each source in a table that mixes them.

The names of a source are the distinct paths of its documents or keys of its lines; what a path can stand
for (itself and its containers, with and without transport wrappers, and every segment) meets the kits'
fingerprints in a join, so neither names nor sources come to the driver and no rule is tried on every
name.  Only the fingerprints are broadcast; they are part of the program.

Defined results: a source without a kit, an empty table's sources and null sources have rows like others
(kit null); texts that are no document or line of the format have no names.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import free_names, kept
from ..sources import lines, trees
from . import classify
from .kits import KITS, Kit

#: Containers deeper than this have no form but their last segment (kits' names have three segments, wrappers two).
DEEPEST = 8


@lru_cache(65_536)
def forms(path: str) -> tuple[str, ...]:
    """What a path can stand for; the work is linear in its length."""
    parts = [p for p in classify.normalised(path).replace("[]", "").split(".") if p]
    out = [f for i in range(1, min(len(parts), DEEPEST) + 1) for f in classify.candidates(".".join(parts[:i]))]
    return tuple(dict.fromkeys(out + parts[DEEPEST:]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _forms(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: list(forms(p)))


def names(df: DataFrame, column: str, fmt: str, by: str) -> DataFrame:
    """(by, name): the distinct paths (``fmt`` json, also for lines of NDJSON) or keys (cef, leef, syslog) of each source."""
    slim = df.select(F.col(f"`{by}`").alias("by"), F.col(f"`{column}`").alias("document"))
    if fmt == "json":
        found = trees.with_leaves(slim, "document", name="leaves").select("by", F.explode("leaves.path").alias("name"))
    else:
        found = slim.select("by", F.explode(lines.PARSERS[fmt][0](F.col("document"))["pairs"]["key"]).alias("name"))
    return found.distinct()


def kits_of(named: DataFrame, kits: dict[str, Kit] = KITS) -> DataFrame:
    """(by, kit, confidence, n_prints, weight): the best kit of each source of ``named`` (by, name), by the rule of
    ``classify.detect_kit``."""
    rows = [(f, k.id, float(w), min(classify.ENOUGH, sum(k.fingerprints.values()) / 3)) for k in kits.values() for f, w in k.fingerprints.items()]
    prints = named.sparkSession.createDataFrame(rows, "form string, kit string, weight double, least double")
    formed = named.where("name IS NOT NULL").select("by", F.explode(_forms("name")).alias("form"))
    met = formed.join(F.broadcast(prints), "form").distinct()
    scored = met.groupBy("by", "kit").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.max("least").alias("least"))
    # one entry a kit at most
    ranked = scored.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("weight", "n", "kit", "least")), asc=False).alias("r"))
    best, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1))["weight"], F.lit(0.0))
    enough = (best["n"] >= 2) & (best["weight"] >= best["least"])
    confidence = F.when(enough, best["weight"] / (best["weight"] + second + 1)).otherwise(0.0)
    return ranked.select("by", F.when(enough, best["kit"]).alias("kit"), confidence.alias("confidence"), best["n"].alias("n_prints"), best["weight"].alias("weight"))


def detect(df: DataFrame, column: str, fmt: str, by: str, kits: dict[str, Kit] = KITS) -> DataFrame:
    """(by, kit, confidence, n_prints, weight) for every source of ``df``."""
    found = kits_of(names(df, column, fmt, by), kits)
    sources = df.select(F.col(f"`{by}`").alias("source")).distinct()
    out = sources.join(found, F.col("source").eqNullSafe(F.col("by")), "left")
    return out.select(F.col("source").alias("by"), "kit", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_prints", F.lit(0)).cast("long").alias("n_prints"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def with_kits(df: DataFrame, column: str, fmt: str, by: str, name: str, kits: dict[str, Kit] = KITS) -> DataFrame:
    """``df`` with the kit of each row's source as column ``name``."""
    (source,) = free_names(df, "source")
    found = kept(detect(df, column, fmt, by, kits), "kits").select(F.col("by").alias(source), F.col("kit").alias(name))
    return df.join(found, F.col(f"`{by}`").eqNullSafe(F.col(source)), "left").drop(source)


def decisions(keys: Column, kit: Column, decide) -> Column:
    """For an array of names, array<struct<action, kind>> of what ``decide(name, kit)`` says: it runs where the rows are, so the
    names of a table may be any number."""

    @F.pandas_udf("array<struct<action:string,kind:string>>")
    def told(names: pd.Series, kit: pd.Series) -> pd.Series:
        decided = lru_cache(65_536)(decide)
        rows = [None if ns is None else [dict(zip(("action", "kind"), decided(n, k), strict=True)) for n in ns] for ns, k in zip(names, kit.astype(object).where(kit.notna(), None), strict=True)]
        return pd.Series(rows, dtype=object)

    return told(keys, kit)
