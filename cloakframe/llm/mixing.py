"""Mixing to target weights by iterative proportional fitting (raking).

Documents fall into cells (source, language, topic); a cell's token count is its starting weight.  Each
round scales the weights so that the sources' totals meet their targets, then the languages', then the
topics', until all margins hold within ``tolerance`` or the error no longer falls.  ``margin_error`` is what is
left; with ``strict`` targets that cannot be met together raise an error.  A cell's factor is its raked weight per token.  Documents are then
sampled by the calibrated probability min(1, c * factor), with c such that the expected tokens are the
``keep`` share of all tokens, or of what the raked cells hold: c grows from the budget over all weight to
the budget that full cells leave over the weight of the others, until no further cell is full.

The topic is the column ``topic`` if ``topic_column`` names one, else what kind of text it is.

Only DataFrame functions are used.  Texts are looked at once and never shuffled: topic and token count are
written with the rows, cells are a map-side combined aggregate of them, and the raking works on that table.  A
margin's step is dealt by category and totals are aggregates, so no step needs all cells in one task; only where the counted number of cells is at most ``small_cells`` they are kept in one partition,
which saves tiny shuffles and gives the same results, and are broadcast to the rows.

The sampling is deterministic: the draw is a hash of seed and doc_id, so repeated rows share their fate.

Defined results: null sources, languages and null or blank texts (topic ``empty``, no tokens, factor 1)
are categories of their own; categories absent from explicit targets get share 0 and are not sampled;
targets of absent categories are ignored and the rest rescaled; an empty table gives an empty result;
extra columns pass through (outputs replace columns of the same name, working columns get free names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, scratch

MARGINS = ("source", "lang", "topic")
OUTPUTS = ("topic", "n_tokens", "factor", "probability", "sampled", "margin_error")


@dataclass(frozen=True)
class Mixing:
    """``targets`` maps a margin to {category: share}; a margin without targets aims at its own token
    shares raised to ``temperature`` (1 keeps them, 0 makes them equal)."""

    targets: dict | None = None
    temperature: float = 0.5
    keep: float = 0.7
    seed: int = 4
    tolerance: float = 1e-6
    max_rounds: int = 400
    rounds_per_job: int = 4
    strict: bool = False
    topic_column: str | None = None
    small_cells: int = 100_000


def topic_of(text: Column) -> Column:
    """A surface topic (the tables carry no topic of their own): what kind of text it is."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(~body.rlike(r"[^\x20\x09-\x0D]"), "empty")
        .when(body.contains(" | "), "table")
        .when(body.rlike("(?i)licen[sc]e|copyright"), "notice")
        .when(body.rlike(r"[0-9]{3}|@"), "records")
        .when(F.length(body) >= 4000, "long prose")
        .otherwise("short prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _aims(cells: DataFrame, p: Mixing) -> DataFrame:
    """Adds the target share of each cell's category in every margin."""
    out = cells
    for m in MARGINS:
        totals = cells.groupBy(F.col(m).alias("_category")).agg(F.sum("tokens").alias("_total"))
        given = (p.targets or {}).get(m)
        if given:
            pairs = [F.lit(x) for kv in sorted(given.items()) for x in (kv[0], float(kv[1]))]
            raw = F.coalesce(F.create_map(*pairs)[F.col("_category")], F.lit(0.0))
        else:
            raw = F.pow(F.col("_total").cast("double"), F.lit(p.temperature))
        raws = totals.select("_category", F.when(F.col("_total") > 0, raw).otherwise(0.0).alias("_raw"))
        aims = raws.crossJoin(F.broadcast(raws.agg(F.sum("_raw").alias("_all")))).select("_category", F.try_divide("_raw", "_all").alias(f"aim_{m}"))  # one row
        out = out.join(aims, F.col(m).eqNullSafe(F.col("_category"))).drop("_category")
    return out


def rake(cells: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, raked shares that meet all margins, and
    ``margin_error``, what is left between a category's share and its target."""
    small = cells.count() <= p.small_cells
    together = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    state = cut(together(_aims(cells, p)).withColumn("weight", F.col("tokens").cast("double")), "rake")
    worst = float("inf")
    for _ in range(0, p.max_rounds, p.rounds_per_job):
        out = together(state)
        for _ in range(p.rounds_per_job):
            for m in MARGINS:
                now = F.sum("weight").over(Window.partitionBy(m))
                out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"aim_{m}") / now).otherwise(0.0))
        state = cut(together(out), "rake")
        before, worst = worst, margin_error(state)
        if worst < p.tolerance:
            break
        if worst > 0.999999 * before:  # it no longer falls
            break
    if worst >= p.tolerance and p.strict:
        raise ValueError(f"the margins cannot be met together: {worst:.3g} is left after raking")
    return state.drop(*[f"aim_{m}" for m in MARGINS]).withColumn("margin_error", F.lit(worst))


def margin_error(cells: DataFrame) -> float:
    """The largest difference between a category's share of the weight and its target."""
    found = [0.0]
    for m in MARGINS:
        sums = cells.where("tokens > 0").groupBy(m).agg(F.sum("weight").alias("s"), F.max(f"aim_{m}").alias("aim"))
        found.append(sums.agg(F.max(F.abs(F.col("s") - F.col("aim")))).first()[0] or 0.0)
    return max(found)


def calibrated(raked: DataFrame, p: Mixing) -> DataFrame:
    """Adds factor and probability to the raked cells."""
    cells = raked.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    live = F.when(F.col("factor") > 0, F.col("tokens")).otherwise(0)
    first = cells.agg(F.sum("tokens").alias("tokens"), F.sum(live).alias("live"), F.sum("weight").alias("weight")).first()
    budget = min((first["tokens"] or 0) * p.keep, float(first["live"] or 0))
    c, full = budget / first["weight"] if first["weight"] else 0.0, -1
    while True:  # each step fills cells or ends
        fills = F.col("factor") * c >= 1
        now = cells.agg(F.count_if(fills).alias("n"), F.sum(F.when(fills, F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(fills, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if (now["n"] or 0) <= full or not now["weight"]:
            break
        c, full = (budget - now["tokens"]) / now["weight"], now["n"]
    chance = F.when(F.col("factor").isNull(), 1.0).when(F.col("factor") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("factor") * c))
    left = [c for c in raked.columns if c == "margin_error"]
    return cells.select(*MARGINS, *left, F.coalesce("factor", F.lit(1.0)).alias("factor"), chance.alias("probability"))


def mix(docs: DataFrame, p: Mixing = Mixing(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with topic, n_tokens, factor, probability, sampled and margin_error."""
    (topic,) = scratch(docs, "topic")
    told = F.col(f"`{p.topic_column}`").cast("string") if p.topic_column else topic_of(F.col(f"`{text}`"))
    rows = docs.withColumn(topic, told)
    rows = rows.drop(*[c for c in rows.columns if c.lower() in OUTPUTS]).withColumnRenamed(topic, "topic")
    rows = cut(rows.withColumn("n_tokens", tokens_of(F.col(f"`{text}`"))), "tokens")
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    own = dict(zip(MARGINS, scratch(rows, *MARGINS), strict=True))
    known = cut(calibrated(rake(cells, p), p), "probabilities").withColumnsRenamed(own)
    if known.count() <= p.small_cells:
        known = F.broadcast(known)
    out = rows.join(known, [F.col(m).eqNullSafe(F.col(own[m])) for m in MARGINS]).drop(*own.values())
    draw = F.expr(f"shiftrightunsigned(xxhash64({p.seed}, `{id_col}`), 11) / {float(1 << 53)}D")
    return out.withColumn("sampled", draw < F.col("probability"))
