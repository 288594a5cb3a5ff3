"""Row numbers that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, block: int = 1_000_000, name: str = "row_number") -> DataFrame:
    """Number the rows of every key by the unique integer column ``order``.

    A plain window would send all rows of a key to one task. Here a key is cut into blocks of the
    order column; rows are numbered inside their block and shifted by the number of rows in earlier
    blocks, which comes from counts (one small row per key and block).
    """
    cut = df.withColumn("__block", F.floor(F.col(order) / block))
    counts = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    numbered = cut.withColumn("__inside", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, "__block"])
    return joined.withColumn(name, (F.col("__inside") + F.col("__offset")).cast("long")).drop("__block", "__inside", "__offset")
