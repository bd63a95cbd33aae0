"""Connected components of an edge table, as rounds of joins and groupings.

Alternates two steps until the edges no longer change: every node hands its neighbours with greater ids
to the least node of its neighbourhood, then its neighbours with smaller ids.  Both keep the components
and make the edges a star around each component's least id, after a number of rounds that grows with
the logarithm of its size.  Groups are only ever minima and joins, and minima are written before they are joined: a
join whose sides are exchanges of its own can be split by adaptive execution where a node has very
many edges, one on top of the grouping's exchange could not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns u and v (any ids, u != v).  Gives (node, component) for every node that has
    an edge; component is the least id of the component."""
    edges = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = cut(_small(_large(edges)), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
