"""A text budget spent in key order: an entry that would overflow is skipped, later and smaller ones are still tried.

What a block of entries takes depends on one number only, the budget left before it. While that number keeps its bit length L, every entry of fewer bits is
taken and every longer one is not; only an entry of exactly L bits has to be compared. So a block is summarized by two numbers per bit length, what its
shorter entries add up to and the least budget at which one of L bits would be taken, and these summaries add up along blocks. A block that changes the bit length is walked itself. There are
at most as many such blocks per image as the limit has bits, so an image of any size is spread over its blocks and no task meets more than one block of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions import utf16_length
from tagloom.operators.repeats import runs_of
from tagloom.session import materialize

NEVER = 2**62
_GROUP = 4096  # summaries whose sums are added up together


def _bits(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(np.float64))[1]


def bit_length(size: Column) -> Column:
    return F.when(size == 0, 0).otherwise(F.length(F.bin(size)))


def spend(sizes: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Which of ``sizes`` (all positive, in order) are taken from a budget of ``left``, and what remains."""
    taken, bits, at = np.zeros(len(sizes), bool), _bits(sizes), 0
    while at < len(sizes) and left > 0:  # once per bit length of what is left
        level, rest = left.bit_length(), bits[at:]
        small = np.where(rest < level, sizes[at:], 0)
        after = left - np.cumsum(small)
        change = (after < 1 << (level - 1)) | ((rest == level) & (sizes[at:] <= after + small))
        end = int(np.argmax(change)) if change.any() else len(rest)
        taken[at : at + end] = rest[:end] < level
        if end == len(rest):
            return taken, int(after[-1])
        taken[at + end] = True
        left = int(after[end] + small[end] - sizes[at + end])
        at += end + 1
    return taken, left


def summarize(sizes: np.ndarray, top: int) -> tuple[list[int], list[int]]:
    """Per bit length 0 to ``top``: the sum of the shorter entries, and the least budget at which an entry of that length is taken."""
    bits, sums, least = _bits(sizes), [0], [NEVER]
    for level in range(1, top + 1):
        small = np.where(bits < level, sizes, 0)
        needed = (np.cumsum(small) - small + sizes)[bits == level]
        sums.append(int(small.sum()))
        least.append(int(needed.min()) if len(needed) else NEVER)
    return sums, least


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
    yield from np.split(flat.to_numpy(zero_copy_only=False), ends[:-1])


def _spend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, dropped = [], []
        for sizes, keys, before in zip(_lists(batch["sizes"]), batch["keys"], batch["left"].to_pylist()):
            taken, after = spend(sizes, before)
            left.append(after)
            dropped.append(keys.values.filter(pa.array(~taken)).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch["image_id"], batch["node"], pa.array(left, pa.int64()), pa.array(dropped, pa.list_(pa.string()))], ["image_id", "node", "left", "dropped"]
        )


def _summary_batches(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = [summarize(sizes, top) for sizes in _lists(batch["sizes"])]
                arrays = [pa.array([b[i] for b in both], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch["image_id"], batch["node"], *arrays], ["image_id", "node", "sums", "least"])

    return run


def _spent(blocks: DataFrame) -> DataFrame:
    image = blocks.schema["image_id"].dataType.simpleString()
    rows = blocks.select("image_id", "node", "left", "keys", "sizes")
    return materialize(rows.mapInArrow(_spend_batches, f"image_id {image}, node long, left long, dropped array<string>"), "spent")


def _next_changes(summaries: DataFrame, state: DataFrame) -> DataFrame:
    """``image_id, level, next, left, node, before``: the first block from ``next`` on that changes the bit length of what is left, and what is taken before it; null without one."""
    level = bit_length(F.col("left"))
    rows = summaries.join(state, "image_id").filter("node >= next").select(
        "image_id", "node", "next", "left", level.alias("level"), F.get("sums", level).alias("sum"), F.get("least", level).alias("needed"),
        F.floor(F.col("node") / _GROUP).alias("part"),
    )
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("image_id", "part").agg(F.sum("sum").alias("total"))
    bases = totals.select("image_id", "part", F.coalesce(F.sum("total").over(earlier("part", "image_id")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("sum").over(earlier("node", "image_id", "part")), F.lit(0))
    rows = rows.withColumn("inside", inside).join(bases, ["image_id", "part"]).withColumn("before", F.col("base") + F.col("inside"))
    there = F.col("left") - F.col("before")
    change = (F.col("level") > 0) & ((there - F.col("sum") < F.expr("shiftleft(1L, level - 1)")) | (F.col("needed") <= there))
    at = F.when(change, F.col("node"))
    return rows.groupBy("image_id", "level", "next", "left").agg(F.min(at).alias("node"), F.min_by("before", at).alias("before"))


def over_budget(entries: DataFrame, limit: int, block: int = 16_384) -> DataFrame:
    """``image_id, key`` of the entries to drop: keys in order, an entry that would overflow is skipped.

    Only images whose total exceeds the limit take part, found by a sum with a partial step; the texts are not moved. Their (key, length) pairs are sorted over all partitions and cut
    into blocks of at most ``block`` pairs. An image of one block needs one step; others take a round for each block that changes the bit length of what is left.
    Entries without text cost nothing and stay, as do those with a null image or key. Entries with the same image and key are all counted and go together. An empty table gives no rows.
    """
    sizes = entries.select("image_id", "key", F.coalesce(utf16_length(F.col("value")), F.lit(0)).cast("long").alias("size")).filter(
        "image_id is not null and key is not null and size > 0"
    )
    heavy = sizes.groupBy("image_id").agg(F.sum("size").alias("total")).filter(F.col("total") > limit).select("image_id")
    sized = sizes.join(heavy, "image_id", "left_semi").select(F.col("image_id").alias("key"), F.col("key").alias("ts"), "size")
    items = F.sort_array(F.collect_list(F.struct("ts", "size")))  # at most one block
    grouped = runs_of(sized, block).groupBy(F.col("key").alias("image_id"), "node").agg(items.alias("i"))
    blocks = materialize(grouped.select("image_id", "node", F.col("i.ts").alias("keys"), F.col("i.size").alias("sizes")), "blocks")

    spent = [_spent(blocks.filter("node = 0").withColumn("left", F.lit(max(limit, 0)).cast("long")))]
    # one row per image of several blocks
    several = blocks.groupBy("image_id").agg(F.max("node").alias("last")).filter("last > 0")
    after = lambda rows: rows.join(several, "image_id").filter("node < last").select("image_id", (F.col("node") + 1).alias("next"), "left")
    state, quiet = after(spent[0]), []
    long_type = f"image_id {entries.schema['image_id'].dataType.simpleString()}, node long, sums array<long>, least array<long>"
    summaries = None
    while not state.isEmpty():  # at most one round per bit of the limit
        if summaries is None:
            long = blocks.join(several, "image_id", "left_semi").select("image_id", "node", "sizes")
            summaries = materialize(long.mapInArrow(_summary_batches(max(limit, 0).bit_length()), long_type), "summaries")
        quiet.append(materialize(_next_changes(summaries, state), "changes"))
        changed = quiet[-1].filter("node is not null").select("image_id", "node", (F.col("left") - F.col("before")).alias("left"))
        spent.append(_spent(blocks.join(changed, ["image_id", "node"])))
        state = after(spent[-1])
    dropped = reduce(DataFrame.unionByName, spent).select("image_id", F.explode("dropped").alias("key"))
    if not quiet:
        return dropped
    spans = reduce(DataFrame.unionByName, quiet).select("image_id", "level", "next", F.coalesce("node", F.lit(NEVER)).alias("until"))
    levels = summaries.select("image_id", "node").join(spans, "image_id").filter("node >= next and node < until").select("image_id", "node", "level")
    pairs = F.arrays_zip("keys", "sizes")
    long_ones = blocks.join(levels, ["image_id", "node"]).select("image_id", F.explode(F.filter(pairs, lambda p: bit_length(p["sizes"]) >= F.col("level"))).alias("p"))
    return dropped.unionByName(long_ones.select("image_id", F.col("p.keys").alias("key")))


def greedy_budget(entries: DataFrame, limit: int, block: int = 16_384) -> DataFrame:
    """The entries that stay within the budget."""
    return entries.join(over_budget(entries, limit, block).distinct(), ["image_id", "key"], "left_anti")
