"""Findings as spans of a text, and the choice among overlapping ones.

Every rule is sought by itself, so a finding is not hidden by one that starts before it; of findings that
overlap the one of higher priority stays, then the longer, then the earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..functions.tokens import let
from .text import classified, pieces, whole

EMPTY = "array<struct<priority:int,size:int,start:int,rule:string,kind:string,category:string,value:string>>"


def spans(text: Column, rule: Rule) -> Column:
    """All accepted findings of one rule: an array of struct(priority, size, start, rule, kind, category, value), start
    counted from 0 in characters."""

    def found(cut: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(cut, 1, i), F.lit(0), lambda n, p: n + F.length(whole(p)))

        def one(p: Column, i: Column) -> Column:
            made = lambda c: F.when(c.isNotNull(), F.struct(F.lit(rule.priority).alias("priority"), F.length(c["value"]).alias("size"), (before(i) + F.length(c["prefix"])).alias("start"), c["rule"].alias("rule"), c["kind"].alias("kind"), c["category"].alias("category"), c["value"].alias("value")))
            return F.when(i % 2 == 1, let(classified(p, (rule,)), made))

        return F.filter(F.transform(cut, one), lambda x: x.isNotNull())

    return let(pieces(text, (rule,)), found)


def resolved(candidates: Column) -> Column:
    """The spans that stay, by place."""
    ranked = F.array_sort(candidates, lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).when(a["size"] != b["size"], b["size"] - a["size"]).otherwise(a["start"] - b["start"]))
    apart = lambda x, y: (x["start"] + x["size"] <= y["start"]) | (y["start"] + y["size"] <= x["start"])
    kept = F.aggregate(ranked, F.array().cast(EMPTY), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def findings(df: DataFrame, stage: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """One row for each finding that stays: the other columns of ``df``, start, rule, kind, category, priority and value."""
    others = [c for c in df.columns if c != text]
    rest = [spans(F.col(text), r) for r in stage]
    out = df.withColumn("_spans", F.concat(F.array().cast(EMPTY), *rest)).where(F.size("_spans") > 0)
    return out.select(*others, F.explode(resolved(F.col("_spans"))).alias("s")).select(*others, "s.start", "s.rule", "s.kind", "s.category", "s.priority", "s.value")
