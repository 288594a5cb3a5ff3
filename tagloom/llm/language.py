"""Language identification by partial matching: the language whose byte model would code a text in the fewest bits.

Each language has a context tree over bytes: how often each byte follows each context of up to ``ORDER`` bytes. A byte seen in the longest context
costs ``-log2(n / (total + kinds))``; otherwise the escape ``kinds / (total + kinds)`` is paid and the context shortened (contexts never seen cost nothing), down to a uniform byte.
Statistics are frozen while scoring, so a byte's code length depends on its context alone. It is therefore computed once per distinct context and byte
of the corpus, by joins between the levels of the trees, and a text's length is the sum over its bytes.

Trees are exact tables that grow with the corpus; nothing is hashed. Code lengths of the most frequent contexts (a bounded number of bytes) go to the tasks that
hold the texts, those of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.llm.labelled import fold
from tagloom.session import materialize

ORDER = 4
START = 256  # stands before the first byte of a text
SYMBOL = 9  # bits of a byte or START
UNIT = 1 << 20  # code lengths are whole multiples of 2**-20 bits, so that sums do not depend on their order
HOT_BYTES = 32 << 20  # most bytes of the broadcast code lengths
BLOCK = 1 << 22


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte its context and itself in one number, the byte in the lowest bits."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    data = data.astype(np.int64)  # START does not fit into a byte
    out = data.copy()
    for j in range(1, order + 1):
        before = np.full(len(data), START, np.int64)
        before[j:] = np.where(place[j:] >= j, data[:-j], START)
        out |= before << (SYMBOL * j)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK bytes of text; a longer text stays whole."""
    held, size = [], 0
    for batch in W.slices(batches, "text"):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass(frozen=True)
class Model:
    """Languages in order and ``gram, seen, bits``: the code length of a byte in its context for each of them, and how often the corpus has it."""

    languages: tuple[str, ...]
    order: int
    lengths: DataFrame | None


def _count(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = SYMBOL * (order + 1)
        for batch in _blocks(batches):
            data, offsets = W.utf8(batch.column("text"))
            owner = np.repeat(batch.column("language").to_numpy() + 1, np.diff(offsets)).astype(np.int64)
            found = pc.value_counts(pa.array(grams_of(data, offsets, order) | owner << shift))
            values, n = found.field("values").to_numpy(), found.field("counts")
            made = pa.record_batch([pa.array(values & ((1 << shift) - 1)), pa.array((values >> shift).astype(np.int32) - 1), n], ["gram", "language", "n"])
            for at in range(0, made.num_rows, 1 << 16):
                yield made.slice(at, 1 << 16)

    return count


def _by_language(rows: DataFrame, key: str, value: Column, n: int, name: str) -> DataFrame:
    """One row per key with an array of ``value`` for each language; each key has a row per language at most."""
    grouped = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("language", value.alias("v")))).alias("m"))
    return grouped.select(key, F.expr(f"transform(sequence(0, {n - 1}), i -> coalesce(try_element_at(m, i), 0L))").alias(name))


def train(docs: DataFrame, folds: int = 5, held_out: int = 0, order: int = ORDER) -> Model:
    """Count the contexts of all texts; those of fold ``held_out`` and those without a language only tell which contexts will be asked for."""
    learn = F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.when(learn, F.col("lang").cast("string")).alias("lang"))
    languages = tuple(sorted(r.lang for r in texts.select("lang").filter("lang is not null").distinct().collect()))
    if not languages:
        return Model((), order, None)
    if SYMBOL * (order + 1) + len(languages).bit_length() > 62:
        raise ValueError("a context and its language must fit into 62 bits")
    n = len(languages)
    place = F.coalesce(F.array_position(F.lit(list(languages)), F.col("lang")).cast("int") - 1, F.lit(-1))
    counted = texts.select("text", place.alias("language")).mapInArrow(_count(order), "gram long, language int, n long")
    level = materialize(counted.groupBy("gram", "language").agg(F.sum("n").alias("n")), "contexts")
    seen = level.groupBy("gram").agg(F.sum("n").alias("seen"))
    levels = [level]
    for k in range(order - 1, -1, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL * (k + 1)) - 1))
        levels.append(materialize(levels[-1].groupBy(short.alias("gram"), "language").agg(F.sum("n").alias("n")), "contexts"))

    chance = None
    for k, rows in enumerate(reversed(levels)):
        context = F.shiftright("gram", SYMBOL)
        learned = rows.filter("language >= 0")
        own = _by_language(rows, "gram", F.col("n"), n, "c").withColumn("context", context)
        nodes = learned.groupBy(context.alias("context"), "language").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        joined = own.join(_nodes(nodes, n), "context", "left")
        if chance is None:
            joined = joined.withColumn("p", F.array_repeat(F.lit(1 / 256), n))
        else:
            joined = joined.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << SYMBOL * k) - 1))).join(chance, "shorter")
        p = F.expr(
            f"transform(sequence(0, {n - 1}), i -> CASE WHEN coalesce(total[i], 0) = 0 THEN p[i] WHEN c[i] > 0 THEN c[i] / (total[i] + kinds[i])"
            " ELSE kinds[i] / (total[i] + kinds[i]) * p[i] END)"
        )
        chance = joined.select(F.col("gram").alias("shorter"), p.alias("p"))
    bits = F.expr(f"transform(p, x -> CAST(round(-log2(x) * {UNIT}) AS BIGINT))")
    lengths = chance.select(F.col("shorter").alias("gram"), bits.alias("bits")).join(seen, "gram")
    return Model(languages, order, materialize(lengths.select("gram", "seen", "bits"), "code-lengths"))


def _nodes(rows: DataFrame, n: int) -> DataFrame:
    """Totals and kinds of bytes per context, as arrays over languages."""
    grouped = rows.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("language", F.struct("total", "kinds").alias("v")))).alias("m"))
    of = lambda name: F.expr(f"transform(sequence(0, {n - 1}), i -> coalesce(try_element_at(m, i).{name}, 0L))").alias(name)
    return grouped.select("context", of("total"), of("kinds"))


def _lookup(shared, order: int, n: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = shared.value
        kind = pa.list_(pa.int64())
        for batch in _blocks(batches):
            data, offsets = W.utf8(batch.column("text"))
            coded = pa.array(grams_of(data, offsets, order)).dictionary_encode()
            grams, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
            hot = known[at] == grams if len(known) else np.zeros(len(grams), bool)
            sums = np.zeros((batch.num_rows, n), np.int64)
            full = np.flatnonzero(np.diff(offsets))
            for i in range(n):
                each = np.where(hot, lengths[at, i], 0) if len(known) else np.zeros(len(grams), np.int64)
                if len(full):
                    sums[full, i] = np.add.reduceat(each[index], offsets[full])
            rows = batch.column("row")
            nulls = pa.nulls(batch.num_rows, pa.int64())
            yield pa.record_batch(
                [rows, batch.column("doc_id"), batch.column("letters"), pa.array(np.diff(offsets)), nulls, nulls, pa.ListArray.from_arrays(np.arange(0, sums.size + 1, n, dtype=np.int32), sums.ravel())],
                schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("letters", pa.bool_()), ("size", pa.int64()), ("gram", pa.int64()), ("times", pa.int64()), ("bits", kind)]),
            )
            far = np.flatnonzero(~hot[index])
            if len(far):
                owner = np.repeat(rows.to_numpy(), np.diff(offsets))[far]
                pairs = pa.table({"row": owner, "gram": grams[index[far]]}).group_by(["row", "gram"]).aggregate([([], "count_all")])
                for part in pairs.combine_chunks().to_batches(max_chunksize=1 << 16):
                    nothing = lambda t: pa.nulls(part.num_rows, t)
                    yield pa.record_batch(
                        [part.column("row"), nothing(pa.int64()), nothing(pa.bool_()), nothing(pa.int64()), part.column("gram"), part.column("count_all").cast(pa.int64()), nothing(kind)],
                        schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("letters", pa.bool_()), ("size", pa.int64()), ("gram", pa.int64()), ("times", pa.int64()), ("bits", kind)]),
                    )

    return look


def predict(docs: DataFrame, model: Model, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score. The model must have been trained on a table with these texts.

    ``lang_pred`` is the language with the shortest code, the first by code point among equals; ``und`` with score 0 for null texts, texts without a letter, and without any learned language.
    ``score`` compares the lengths: ``1 / sum(2 ** -(bits - least) / sqrt(bytes))``, 1 where all other languages are far longer. Very long texts are scored whole,
    repeated rows alike; other columns are ignored and an empty table gives no rows.
    """
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), letters.alias("letters"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    if not model.languages:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(model.languages)
    lengths = model.lengths
    cls = F.floor(F.log2("seen"))
    room, least = hot_bytes // (8 * (n + 1)), 64
    for r in sorted(lengths.groupBy(cls.alias("c")).count().collect(), key=lambda r: -r.c):
        room -= r["count"]
        if room < 0:
            break
        least = r.c
    hot = lengths.filter(cls >= least).select("gram", "bits").toArrow().sort_by("gram").combine_chunks() if least < 64 else None
    known = hot["gram"].to_numpy() if hot is not None else np.zeros(0, np.int64)
    table = hot["bits"].combine_chunks().flatten().to_numpy().reshape(-1, n) if hot is not None and len(known) else np.zeros((0, n), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, table))
    schema = "row long, doc_id long, letters boolean, size long, gram long, times long, bits array<long>"
    found = materialize(texts.mapInArrow(_lookup(shared, model.order, n), schema), "code-sums")
    near = found.filter("gram is null").select("row", "doc_id", "letters", "size", "bits")
    far = found.filter("gram is not null").select("row", "gram", "times").join(lengths.filter(cls < least).select("gram", F.col("bits").alias("each")), "gram")
    far = far.select("row", "times", F.posexplode("each").alias("language", "b")).groupBy("row", "language").agg(F.sum(F.col("b") * F.col("times")).alias("more"))
    far = _by_language(far, "row", F.col("more"), n, "more")
    total = F.zip_with("bits", F.coalesce("more", F.array_repeat(F.lit(0).cast("long"), n)), lambda x, y: x + y)
    scored = near.join(far, "row", "left").select("doc_id", "letters", "size", total.alias("total")).withColumn("best", F.array_min("total"))
    spread = F.sqrt(F.greatest("size", F.lit(1)).cast("double")) * UNIT
    share = F.aggregate(F.transform("total", lambda x: F.pow(F.lit(2.0), -(x - F.col("best")) / spread)), F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.lit(list(model.languages)), F.array_position("total", F.col("best")).cast("int"))
    return scored.select("doc_id", F.when(F.col("letters"), name).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), 1 / share).otherwise(0.0).alias("score"))
