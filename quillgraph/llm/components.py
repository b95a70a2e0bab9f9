"""Connected components over a distributed list of links.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each step is one aggregation and
one join, hot nodes are summed before the shuffle, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.shared import cut, drop


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. One step; returns distinct (u, v) with u > v."""
    if large:
        near = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        out = near.filter(F.col("y") > F.col("x")).join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(low, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node.

    Nulls and links of a node to itself count for nothing; repeated links count once.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("p"), F.col(b).isNotNull().alias("q"))
    e = cut(e.filter(F.col("p") & F.col("q") & (F.col("u") > F.col("v"))).select("u", "v").distinct())
    seen = None
    for _ in range(most):
        before, e = e, cut(_star(_star(e, large=True), large=False))
        drop(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError("components did not settle")
