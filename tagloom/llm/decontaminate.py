"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

A document is leaked when some window of it has a weighted-shingle similarity of at least ``percent`` / 100 with a benchmark item.
An item of n shingles can lose few of them then, so some run of its words, whose length follows from n alone, occurs unchanged. Windows are
cut to that length (a multiple of STEP shingles, so a document needs windows at every STEP-th word only), each fingerprinted by SimHash over its
shingles, and compared with the fingerprints of all equally long windows of the items. The fingerprint is split into blocks: two
fingerprints within ``blocks - 1`` differing bits agree on one block at least, so looking up each block finds all
fingerprints within that radius. What lies within it is verified: the exact weighted similarity (shingles count as
often as they occur) of the item and of every window around the hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.session import materialize

U = np.uint64
STEP = 4
BLOCKS = 4  # of 16 bits; the radius is one less
BYTES_PER_PASS = 16 << 20


def clean_run(n_words: int, k: int, percent: int) -> int:
    """Words that surely occur in one unchanged run if the similarity with an item of ``n_words`` is ``percent`` or more.

    Between two runs at least ``k - 1`` shingles of the item are missing (cuts ``lost``) or as many others stand in the window (cuts ``added``), whether words
    were changed, left out, put in or moved. So at most ``n - (k - 1) lost`` of n shingles are common, the union has ``n + (k - 1) added`` at least, and
    the longest of the runs has its share of the common ones. Items that repeat runs of ``k - 1`` words can be put together anew without a cut; they are not covered.
    """
    k = min(k, n_words)
    if k < 2:
        return 1
    n = n_words - k + 1
    least, added = n_words, 0
    while added <= n and (common := -(-percent * (n + (k - 1) * added) // 100)) <= n:  # shingles that must stay
        lost = (n - common) // (k - 1)
        least = min(least, -(-common // (added + lost + 1)) + k - 1)
        added += 1
    return max(1, least)


def window_length(n_words: int, k: int, percent: int) -> tuple[int, int]:
    """(length, step) of the windows for an item: a multiple of STEP shingles at every STEP-th word, or for short items any length at every word."""
    run = clean_run(n_words, k, percent)
    count = (run - STEP + 1 - k + 1) // STEP * STEP
    return (count + k - 1, STEP) if count >= STEP else (run, 1)


def _bit_sums(grams: np.ndarray, step: int, most: int) -> np.ndarray:
    """Running sums of the 64 hash bits over every ``step`` shingles. Sums may wrap; differences over up to ``most`` shingles do not."""
    whole = len(grams) // step * step
    kind = np.uint8 if most < 256 else np.uint32
    bits = np.unpackbits(grams[:whole].view(np.uint8)).reshape(-1, step, 64)
    sums = np.zeros((whole // step + 1, 64), kind)
    part = bits[:, 0].astype(kind)
    for j in range(1, step):
        part += bits[:, j]
    np.cumsum(part, axis=0, dtype=kind, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, steps: int, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each step on: the sign of the summed bits of their hashes."""
    inside = sums[steps:] - sums[:-steps]
    return np.packbits(inside > count // 2, axis=1).view(U).reshape(-1)


class Index:
    """Fingerprints of the items' windows by length and block. Its size is bounded by the words of the items."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, percent: int):
        self.k, self.percent, self.items, self.lengths = k, percent, [], {}
        gathered: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            words = W.words_of(*W.utf8(pa.array([text or ""])))
            n = len(words.hashes)
            if item_id is None or n == 0:
                continue
            bag = Counter(next(W.shingles_of(words, k)).tolist())
            length, step = window_length(n, k, percent)
            size = min(k, length)
            count = length - size + 1
            prints = _fingerprints(_bit_sums(W.grams(words.hashes, size), 1, count), count, count)
            gathered.setdefault((length, step), []).extend((f, len(self.items), o) for o, f in enumerate(prints.tolist()))
            self.items.append((item_id, n, bag))
        for key, rows in gathered.items():
            prints = np.array([r[0] for r in rows], U)
            tables = []
            for b in range(BLOCKS):
                part = prints.view(np.uint16).reshape(-1, BLOCKS)[:, b].astype(np.int64)
                order = np.argsort(part, kind="stable")
                tables.append((np.searchsorted(part[order], np.arange(65537)), order))
            self.lengths[key] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables)
        self.most = max((length for length, _ in self.lengths), default=0)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(word place, item, place in the item) of every window within the radius, over the words of several texts."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for (length, step), (prints, items, places, tables) in self.lengths.items():
            size = min(self.k, length)
            count = length - size + 1
            if len(hashes) < length:
                continue
            if (size, step) not in sums:
                sums[size, step] = _bit_sums(W.grams(hashes, size), step, self.most)
            if len(sums[size, step]) <= count // step:
                continue
            found = _fingerprints(sums[size, step], count // step, count)
            blocks = found.view(np.uint16).reshape(-1, BLOCKS)
            seen = set()
            for b, (head, order) in enumerate(tables):
                part = blocks[:, b]
                at = np.flatnonzero((head[1:] > head[:-1])[part])
                if not len(at):
                    continue
                part = part[at].astype(np.int64)
                n = head[part + 1] - head[part]
                window = np.repeat(at, n)
                entry = order[np.repeat(head[part], n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)]
                far = np.bitwise_count(found[window] ^ prints[entry])
                near = far < BLOCKS
                start, entry = window[near] * step, entry[near]
                whole = start + length <= first[np.searchsorted(first, start, side="right")]  # windows that stay in one text
                seen.update(zip(start[whole].tolist(), items[entry[whole]].tolist(), places[entry[whole]].tolist()))
            yield from seen

    def best(self, grams: np.ndarray, item: int, places: list[int]) -> float:
        """Highest similarity of the item with a window of the text that holds one of the ``places``; 0 where all are below ``percent``.

        ``grams`` are the text's shingles. Windows of up to ``100 / percent`` of the item's shingles are tried; longer ones cannot be similar enough.
        """
        bag = self.items[item][2]
        size = sum(bag.values())
        longest = size * 100 // self.percent if self.percent else len(grams)
        best = 0.0
        for begin, end in _merged(places, longest):
            low, high = begin, min(len(grams), end)
            values = grams[low:high]
            # A shingle is common to a window unless it is not the item's, or the window already holds as many of it as the item.
            before = np.full(len(values), len(values), np.int64)
            for value in set(values.tolist()) & bag.keys():
                at = np.flatnonzero(values == value)
                before[at] = np.concatenate((np.full(bag[value], -1), at))[: len(at)]
            own = before < len(values)
            held = np.concatenate(([0], np.cumsum(own)))
            ends = np.minimum(np.arange(len(values)) + longest, len(values))
            for a in np.flatnonzero(own & ((held[ends] - held[:-1]) * 100 >= self.percent * size)).tolist():
                common = np.cumsum(before[a : a + longest] < a)
                best = max(best, float((common / (size + np.arange(1, len(common) + 1) - common)).max()))
                if best == 1:
                    return best
        return best if best * 100 >= self.percent else 0.0


def _merged(places: list[int], longest: int) -> Iterator[tuple[int, int]]:
    """Spans of shingles that windows of up to ``longest`` around the places can cover; overlapping ones are one."""
    begin = end = None
    for place in sorted(set(places)):
        if end is not None and place - longest + 1 <= end:
            end = place + longest
            continue
        if end is not None:
            yield begin, end
        begin, end = max(0, place - longest + 1), place + longest
    if end is not None:
        yield begin, end


def search(index: Index, texts: pa.Array) -> tuple[list[list[int]], list[float]]:
    """Per text the ids of the items found, and the highest similarity."""
    k, percent = index.k, index.percent
    words = W.words_of(*W.utf8(texts))
    found: list[dict[int, float]] = [{} for _ in range(len(texts))]
    by_text: dict[int, dict[int, list[int]]] = {}
    for place, item, _ in index.hits(words.hashes, words.first):
        text = int(np.searchsorted(words.first, place, side="right")) - 1
        by_text.setdefault(text, {}).setdefault(item, []).append(place - int(words.first[text]))
    for text, tries in by_text.items():
        own = words.hashes[words.first[text] : words.first[text + 1]]
        grams: dict[int, np.ndarray] = {}
        for item, places in sorted(tries.items()):
            size = min(k, index.items[item][1])
            if size not in grams:
                grams[size] = W.grams(own, size)
            if (value := index.best(grams[size], item, places)) * 100 >= percent:
                found[text][item] = value
    return [sorted({index.items[i][0] for i in f}) for f in found], [max(f.values(), default=0.0) for f in found]


def leak_rows(index: Index):
    """A batch function: doc_id, text -> doc_id, items (ids of the benchmark items found), similarity (the highest, 0 without)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            items, similarity = search(index, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(items, pa.list_(pa.int64())), pa.array(similarity, pa.float64())], ["doc_id", "items", "similarity"])

    return apply


class _Passes:
    """Blocks of about ``items_per_pass`` items and BYTES_PER_PASS bytes, dealt by a hash. Each is collected when its index is asked for and held by the caller alone."""

    def __init__(self, benchmark: DataFrame, k: int, percent: int, items_per_pass: int):
        self.k, self.percent = k, percent
        named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        self.items = named.filter("item_id is not null and text is not null").distinct()
        n, size = self.items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.number = max(1, -(-n // items_per_pass), -(-size // BYTES_PER_PASS))

    def index(self, part: int) -> Index:
        rows = self.items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.number)) == part)
        return Index([tuple(r) for r in rows.collect()], self.k, self.percent)


def _found(rows: DataFrame, key: str, passes: _Passes) -> DataFrame:
    """key, items, similarity of the ``rows (key, text)`` with a hit in any pass: each pass's hits are written before the next index is built."""

    def written(part: int) -> DataFrame:
        found = rows.select(F.col(key).alias("doc_id"), "text").mapInArrow(leak_rows(passes.index(part)), "doc_id long, items array<long>, similarity double")
        return materialize(found.filter(F.size("items") > 0).withColumnRenamed("doc_id", key), "leaks")

    out = written(0)
    for part in range(1, passes.number):
        out = out.unionByName(written(part))
    return out.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("similarity").alias("similarity"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once with a number of their own, and the name of its column."""
    key = "row"
    while key in {c.lower() for c in rows.columns}:
        key += "_"
    return materialize(rows.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, items_per_pass: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, items, similarity.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. ``items`` are the ids of all items that the text holds at
    ``percent`` or more, ascending; empty with similarity 0 for clean, empty and null texts. Items without words or id find nothing;
    items shorter than ``k`` words are one shingle. About ``items_per_pass`` items are on the driver and in a task at a time; a larger benchmark takes several passes
    over the documents, written once with row numbers, by which the hits of all passes are combined. An empty benchmark leaves all clean.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = _Passes(benchmark, k, percent, items_per_pass)
    if passes.number == 1:
        return plain.mapInArrow(leak_rows(passes.index(0)), "doc_id long, items array<long>, similarity double")
    rows, key = _numbered(plain)
    joined = rows.select("doc_id", key).join(_found(rows, key, passes), key, "left")
    return joined.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, items_per_pass: int = 20_000) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns as they are; null and empty texts stay.

    No text is moved in a single pass over the items; for several the rows are written once with row numbers, which those with hits are dropped by.
    """
    passes = _Passes(benchmark, k, percent, items_per_pass)
    if passes.number == 1:
        return docs.filter(~_leaked(passes.index(0))(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows, key = _numbered(docs)
    texts = rows.select(key, F.col("text").cast("string").alias("text"))
    return rows.join(_found(texts, key, passes).select(key), key, "left_anti").select(*docs.columns)


def _leaked(index: Index):
    @F.arrow_udf("boolean")
    def leaked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.record_batch([column], ["text"])
            yield pa.array([bool(items) for part in W.slices(iter([batch]), "text") for items in search(index, part.column("text"))[0]], pa.bool_())

    return leaked
