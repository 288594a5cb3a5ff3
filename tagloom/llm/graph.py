"""Connected components of an edge table that may hold hubs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows ``(hi, lo)`` with ``hi > lo``; neighbours meet only through an aggregate and a join."""
    up, down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    seen = up.unionByName(down) if large else up
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.filter(F.col("hi") > F.col("lo")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no ``hi`` has two edges, none is the ``lo`` of another."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges (a, b)`` that is not its own root; the root is the smallest node reachable.

    Both columns are long and not null. Loops and repeated edges are allowed; an empty table gives an empty one. ``edges`` is read
    several times: pass a written table. Every step is written to the shared folder, so lost executors repeat one step at most.
    """
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo")
    while True:
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        if _settled(now):
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
