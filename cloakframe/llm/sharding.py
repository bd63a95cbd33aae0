"""Proportional stratified interleaving.

Rows of each source are put in a seeded random order; row r of n gets the fractional rank (r - 1/2) / n.
Sorting all rows by fractional rank interleaves the sources in proportion, so any run of consecutive
rows has the mixture of the whole, and cutting the sequence into equal runs gives shards that all match
the mixture.  Shard sizes differ by one row at most (law ``rows``).

Neither the ranks within a source nor the global positions are computed in one task per source or over
one sorted whole: the order is split into buckets of about sqrt(rows) rows (by the leading bits of the
random key, then by the leading digits of the fractional rank), buckets are counted, running totals of
the counts give each bucket's offset, and only rows within a bucket are numbered by a window.  Only
DataFrame functions are used.

Defined results: null sources are a source of their own; repeated rows are placed like others (equal
rows are interchangeable, so the result does not depend on which is which); an empty table gives an
empty result; fewer rows than shards leave shards empty; extra columns pass through (outputs replace
columns of the same name, working columns get free names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch


def _bits(rows: int) -> int:
    """Bits of the number of buckets: buckets of about sqrt(rows), 1000 at least."""
    return max(0, math.ceil(math.log2(max(1.0, rows / max(1000.0, math.sqrt(max(rows, 1)))))))


def _numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column], rank: str, total: str | None) -> DataFrame:
    """Adds ``rank``: the number (from 1) of each row among those with equal ``keys``, by bucket, then by
    ``order``; and ``total``, their count."""
    offset, size = scratch(df, f"offset_{rank}", f"size_{rank}")
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias(size))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(offset, F.coalesce(F.sum(size).over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum(size).over(whole))
    own = dict(zip([*keys, bucket], scratch(df.withColumn(offset, F.lit(0)), *[f"of_{c}" for c in [*keys, bucket]]), strict=True))
    counts = counts.drop(size).withColumnsRenamed(own)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{k}`")) for c, k in own.items()]
    joined = df.join(counts, same).drop(*own.values())
    number = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return joined.withColumn(rank, number + F.col(offset)).drop(offset)


def interleave(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", source: str = "source", content: str = "text") -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in a shard)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    n = docs.count()
    key, tie, b1, rank, size, frac, b2, pos = scratch(docs, "key", "tie", "bucket", "rank", "total", "frac", "bucket2", "pos")
    bits = _bits(n)
    out = docs.withColumn(tie, F.xxhash64(F.col(f"`{content}`"), F.lit(seed))).withColumn(key, F.expr(f"shiftrightunsigned(xxhash64({seed}, `{id_col}`, `{tie}`), 1)"))
    out = out.withColumn(b1, F.expr(f"shiftrightunsigned({key}, {63 - bits})"))
    order = [F.col(key), F.col(f"`{id_col}`"), F.col(tie)]
    out = _numbered(out, [source], b1, order, rank, size).drop(b1)
    out = out.withColumn(frac, (F.col(rank) - F.lit(0.5)) / F.col(size)).drop(rank, size)
    out = out.withColumn(b2, F.floor(F.col(frac) * float(1 << bits)))
    out = _numbered(out, [], b2, [F.col(frac), F.xxhash64(F.col(f"`{source}`"), F.lit(seed)), F.col(f"`{source}`"), *order], pos, None)
    at = f"({pos} - 1L)"
    out = out.withColumn("shard", F.expr(f"cast({at} * {shards} div {max(n, 1)} AS int)"))
    out = out.withColumn("slot", F.expr(f"{at} - (shard * {max(n, 1)}L + {shards - 1}) div {shards}"))
    return out.drop(key, tie, frac, b2, pos)
