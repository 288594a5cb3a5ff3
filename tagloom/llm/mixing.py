"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key; within its source the keys are range-sorted in blocks, block totals give the
distributed prefix sums of word counts, and each source is cut at its exact budget: whole epochs first,
then the documents in key order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 2_000  # documents of one source that a sorted block holds on average


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sources (source, rows, source_size)`` with ``target``: shares of all sizes by weight, at most ``most`` times a source's size.

    Sources by code point, null last, take the weights in turn. What a source cannot take is shared by weight among the others until none
    is above its limit: with sources in order of limit over weight, the full ones are a prefix, which one running sum finds.
    One row per source: its windows hold as many rows as there are sources.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    rated = sources.withColumn("weight", cases).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # The level at which the open sources would stand if exactly those before this one were full.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = rated.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    stand = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"]
    return levels.withColumn("stand", stand).select(
        "source", "rows", "source_size",
        F.when(F.col("stand").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("stand") * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``docs`` needs doc_id, source and text; other columns are ignored. ``size`` counts words, null text has none. ``target`` is the source's. ``taken`` is how
    many of the document's words the mix takes, repeats counted: whole epochs, and the rest by ascending ``md5(seed:doc_id)``
    (null as empty; equal ones by size), so that a source's words add up to its rounded target; at most ``most`` epochs when that is whole.
    Nothing is random: reruns agree. Repeated rows with equal doc_id are mixed one after the other. A source without words takes nothing.
    An empty table gives an empty one.
    """
    sized = materialize(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        ),
        "sized",
    )
    per_source = targets(sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), weights, most)
    budget = F.round("target").cast("long")
    plan = per_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", budget - F.col("epochs") * F.col("source_size")
    )
    plan = plan.withColumn("blocks", F.ceil(F.col("rows") / block_rows)).withColumn("place", F.struct(F.col("source").isNull().alias("none"), "source"))
    # Hash keys are even, so equal ranges of their first 32 bits are blocks of nearly equal size.
    start = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = sized.withColumnRenamed("source", "own").join(plan, F.col("own").eqNullSafe(F.col("source"))).drop("own", "place").withColumn(
        "block", F.shiftright(start * F.col("blocks"), 32)
    )
    totals = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead")
    )
    inner = Window.partitionBy("source", "block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    )
    left = F.col("rest") - F.col("ahead") - F.col("before")
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).alias("taken"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {docs}),
per AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight,
         source_size * 3.0::DOUBLE AS most
  FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stands AS (
  SELECT level AS stand FROM levels WHERE level * weight <= most ORDER BY most / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, coalesce(least(most, (SELECT stand FROM stands) * weight), most) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(p.epochs * s.size + greatest(0, least(s.size, CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size
         - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
"""
