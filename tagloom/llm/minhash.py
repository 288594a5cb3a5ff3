"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
half as many evaluations fill a signature. The values are cut into bands; texts that agree on a band
share a bucket. Buckets only propose pairs: every link is confirmed on the full shingle sets.

Buckets are resolved without listing their pairs. Each round picks some pivots per bucket and compares
them with the members of other components; what is linked joins the pivot's component, the pivot
leaves. A bucket is settled once its members lie in one component, so a group of n copies costs about n comparisons,
while members that stay apart are compared until no pair of the bucket is left: no link is lost
and nothing is capped.

A large family of near copies leaves many members that stay apart though they share most shingles, each of which meets the others
in many bands. Such pairs are told apart without their texts by the parities of their sets: the shingles that some other text
has too fall into PARITIES groups by hash, a bit says whether a group holds an odd number of them. Every bit that differs between two sets
stands for at least one shingle that only one of them has, so the bits that differ bound from above what they have in common. The bound is exact: no link is lost by it.
Sets that differ in far more shingles than there are groups look alike in half of the bits, and then nothing is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.llm.graph import components
from tagloom.session import materialize

U = np.uint64
CACHED = 4_000_000  # shingle hashes that a confirming task keeps, 32 MB
PARITIES = 512  # groups of shingle hashes, in longs of 64 bits


def _keys(words: W.Words) -> list[bytes | None]:
    """128-bit key of each text's word sequence; None without words."""
    place = np.arange(len(words.hashes), dtype=np.uint64)
    sums = [np.concatenate(([U(0)], np.cumsum(W.mix(words.hashes ^ salt) * (U(2) * place + U(1)), dtype=np.uint64))) for salt in (U(0x51ED27), U(0xA0761D))]
    plain = [np.concatenate(([U(0)], np.cumsum(W.mix(words.hashes ^ salt), dtype=np.uint64))) for salt in (U(0x51ED27), U(0xA0761D))]
    a, b = words.first[:-1], words.first[1:]
    parts = []
    for s, p in zip(sums, plain):  # positions count from the text's own first word
        parts.append(W.mix((s[b] - s[a]) - U(2) * a.astype(np.uint64) * (p[b] - p[a]) + (b - a).astype(np.uint64)))
    packed = np.stack(parts, axis=1).tobytes()
    return [packed[16 * i : 16 * i + 16] if n else None for i, n in enumerate((b - a).tolist())]


def _parities(found: np.ndarray) -> np.ndarray:
    """Whether each group of shingle hashes holds an odd number of ``found``, 64 groups a long, the first in the lowest bit."""
    odd = np.bincount((found & U(PARITIES - 1)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def signatures(permutations: int, bands: int, rows: int, k: int, seed: int = 1):
    """A batch function: doc_id, text -> doc_id, key, n_shingles, bands array<long>, sketch (a byte of each signature value), parities array<long>."""
    draw = np.random.default_rng(seed)
    times = (draw.integers(0, 1 << 31, permutations, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    plus = draw.integers(0, 1 << 32, permutations, dtype=np.uint32)
    order = draw.permutation(2 * permutations)[: bands * rows]
    band_salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            data, offsets = W.utf8(batch.column("text"))
            words = W.words_of(data, offsets)
            n = np.zeros(batch.num_rows, np.int64)
            values = np.zeros((batch.num_rows, 2 * permutations), np.uint32)
            parities = np.zeros((batch.num_rows, PARITIES // 64), np.int64)
            for i, found in enumerate(W.shingles_of(words, k)):
                if not len(found):
                    continue
                found = W.distinct(found)
                n[i] = len(found)
                parities[i] = _parities(found)
                short = (found >> U(32)).astype(np.uint32)
                low = np.full(permutations, 0xFFFFFFFF, np.uint32)
                high = np.zeros(permutations, np.uint32)
                for at in range(0, len(short), 2048):
                    turned = times[:, None] * short[None, at : at + 2048] + plus[:, None]
                    np.minimum(low, turned.min(axis=1), out=low)
                    np.maximum(high, turned.max(axis=1), out=high)
                values[i] = np.concatenate((low, high))
            banded = W.grams(values[:, order].astype(np.uint64).reshape(-1), rows)[:: rows].reshape(batch.num_rows, bands)
            banded = W.mix(banded ^ band_salt[None, :])
            flat = pa.array(banded.reshape(-1).view(np.int64))
            marks = W.mix(values.astype(np.uint64)).astype(np.uint8).tobytes()
            width = 2 * permutations
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(_keys(words), pa.binary()),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * bands, bands, dtype=np.int32)), flat),
                    pa.array([marks[at : at + width] for at in range(0, len(marks), width)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, parities.size + 1, parities.shape[1], dtype=np.int32)), pa.array(parities.reshape(-1))),
                ],
                ["doc_id", "key", "n_shingles", "bands", "sketch", "parities"],
            )

    return apply


def keyed_texts(k: int):
    """A batch function: text -> key, text, without texts that have no words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            keys = pa.array(_keys(W.words_of(*W.utf8(batch.column("text")))), pa.binary())
            yield pa.record_batch([keys, batch.column("text")], ["key", "text"]).filter(keys.is_valid())

    return apply


def likely(percent: int, margin: float):
    """A batch function: a, b, sketch_a, sketch_b -> the pairs whose estimated similarity is not below the bound by more than ``margin``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "sketch_a", "sketch_b"):
            x, y = (W.utf8_bytes(batch.column(c)).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield batch.select(["a", "b"]).filter(pa.array(same >= percent / 100 - margin))

    return apply


def confirmed(k: int, percent: int):
    """A batch function: a, b, text_a, text_b -> the pairs with 100 * common >= percent * united on full sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sets of nodes seen lately; emptied when it holds CACHED values
        held = 0
        for batch in W.slices(batches, "text_a", "text_b"):
            sides = []
            for side in ("a", "b"):
                ids = batch.column(side).to_numpy().tolist()
                new = {node: i for i, node in enumerate(ids) if node not in known}
                texts = batch.column(f"text_{side}").take(pa.array(list(new.values()), pa.int32()))
                for node, found in zip(new, W.shingles_of(W.words_of(*W.utf8(texts)), k)):
                    known[node] = W.distinct(found)
                    held += len(known[node])
                sides.append([known[node] for node in ids])
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sides)):
                ordered = np.sort(np.concatenate((x, y)))
                both = int(np.count_nonzero(ordered[1:] == ordered[:-1]))
                keep[i] = 100 * both >= percent * (len(ordered) - both)
            if held > CACHED:
                known, held = {}, 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return apply


def shingle_rows(k: int):
    """A batch function: node, text -> node, shingle: one row per distinct shingle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            sets = [W.distinct(s) for s in W.shingles_of(W.words_of(*W.utf8(batch.column("text"))), k)]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    return apply


def _pivot_pairs(members: DataFrame, slots: int, round_no: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of this round and the members left. ``members``: bucket, node, n, own, parities, root.

    Each bucket's members fall into ``slots`` slots; the member with the least hash of each slot is a pivot.
    """
    spread = members.withColumn("h", F.xxhash64("node", F.lit(round_no))).withColumn("slot", F.pmod(F.xxhash64("h"), F.lit(slots)))
    pivots = spread.groupBy("bucket", "slot").agg(F.min(F.struct("h", "node", "n", "own", "parities", "root")).alias("p")).select(
        "bucket", "slot", F.col("p.h").alias("ph"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.own").alias("pown"), F.col("p.parities").alias("pparities"), F.col("p.root").alias("proot")
    )
    met = spread.join(pivots.drop("slot"), "bucket")
    # Only shingles that neither side has alone can be common, and of these not the ones that make a parity differ:
    # pairs that cannot reach the bound for that are no candidates.
    mine, theirs = F.col("n") - F.col("own"), F.col("pn") - F.col("pown")
    differ = sum((F.bit_count(F.col("parities")[i].bitwiseXOR(F.col("pparities")[i])) for i in range(PARITIES // 64)), F.lit(0))
    twice = F.least(F.lit(2) * mine, F.lit(2) * theirs, mine + theirs - differ)  # twice the largest number they can have in common
    pairs = met.filter((F.col("root") != F.col("proot")) & (F.lit(100 + percent) * twice >= F.lit(2 * percent) * (F.col("n") + F.col("pn")))).select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    left = spread.join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti").select("bucket", "node", "n", "own", "parities")
    return pairs, left


def _alone(single: DataFrame) -> DataFrame:
    """node, own (how many), own_parities of the shingles that one text alone has. ``single``: shingle, held, node."""
    group = F.col("shingle").bitwiseAND(F.lit(PARITIES - 1))
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    words = (F.bit_xor(F.when(F.shiftright(group, 6) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(PARITIES // 64))
    return single.filter("held = 1").groupBy("node").agg(F.count("*").alias("own"), *(w.alias(f"w{i}") for i, w in enumerate(words))).select(
        "node", "own", F.array(*(f"w{i}" for i in range(PARITIES // 64))).alias("own_parities")
    )


def _both(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``column`` of either side of each pair."""
    a, b = (texts.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", f"{column}_a", f"{column}_b")


def _resolve(docs: DataFrame, k: int, percent: int, bands: int, rows: int, permutations: int, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures per row, distinct word sequences, and the root of every node that is linked to another."""
    if bands * rows > 2 * permutations:
        raise ValueError("bands * rows must not exceed twice the permutations")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_seen = materialize(
        plain.mapInArrow(signatures(permutations, bands, rows, k), "doc_id long, key binary, n_shingles long, bands array<long>, sketch binary, parities array<long>"), "signatures"
    )
    worded = rows_seen.filter(F.col("key").isNotNull())
    # One node per distinct word sequence; copies meet in a partial aggregate.
    nodes = materialize(
        worded.groupBy("key").agg(
            F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parities").alias("parities")
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    left = materialize(banded.join(shared.select("bucket"), "bucket", "left_semi"), "buckets")
    wanted = left.select("node").distinct().join(nodes.select("node", "key", "sketch"), "node")
    texts = materialize(
        plain.select("text").mapInArrow(keyed_texts(k), "key binary, text string").join(wanted, "key").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text")),
        "texts",
    )
    # Shingles that only one of these texts has, per text: they are common with nothing.
    single = texts.select("node", "text").mapInArrow(shingle_rows(k), "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("held"), F.min("node").alias("node"))
    parity = F.coalesce(F.zip_with("parities", "own_parities", lambda x, y: x.bitwiseXOR(y)), "parities")
    traits = nodes.join(_alone(single), "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"), parity.alias("parities"))
    left = materialize(left.join(traits, "node").select("bucket", "node", "n", "own", "parities"), "buckets")
    roots, slots, round_no = None, 1, 0
    while True:
        if roots is None:
            members = left.withColumn("root", F.col("node"))
        else:
            members = left.join(roots.withColumnRenamed("root", "r"), "node", "left").select("bucket", "node", "n", "own", "parities", F.coalesce("r", "node").alias("root"))
            open_buckets = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
            members = materialize(members.join(open_buckets, "bucket", "left_semi"), "members")
            if members.isEmpty():
                break
        pairs, left = _pivot_pairs(members, slots, round_no, percent)
        left = materialize(left, "buckets")
        hopeful = materialize(_both(pairs, texts, "sketch").mapInArrow(likely(percent, margin), "a long, b long"), "pairs")
        found = _both(hopeful, texts, "text").mapInArrow(confirmed(k, percent), "a long, b long")
        found = materialize(found, "links")
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():
            roots = components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        slots, round_no = min(4096, slots * 64), round_no + 1
    return rows_seen, nodes, roots


def _by_key(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """key, component_id per distinct word sequence, and whether it stands for its component: the key of the smallest doc_id, equal ones by key."""
    linked = nodes.select("node", "key", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")
    least = linked.groupBy("root").agg(F.min(first).alias("first"))
    return linked.join(least, "root").select("key", F.col("first.least_id").alias("component_id"), (F.col("first.key") == F.col("key")).alias("stands"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 38, rows: int = 5, permutations: int = 96, margin: float = 0.13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored whatever they are called. Texts
    are linked when ``100 * common >= percent * united`` over their sets of distinct ``k``-word shingles (fewer words: the
    whole sequence is one shingle). Texts without words, null ones included, have n_shingles 0 and are linked with nothing.
    ``component_id`` is the smallest doc_id reachable over links, null only if none of these has a doc_id;
    ``kept`` says whether it is the row's own (null equals null). Repeated rows come out once each. An empty table gives an empty one.

    A threshold pair shares no band with a chance of about ``(1 - s**rows)**bands`` (3e-7 for 38 x 5 at 0.8 and for
    32 x 6 at 0.85). ``margin`` is how far below the bound the similarity estimated from the whole signature may lie before a
    pair is not read in full: 4.5 standard deviations of the estimate.
    """
    rows_seen, nodes, roots = _resolve(docs, k, percent, bands, rows, permutations, margin)
    return (
        rows_seen.select("doc_id", "n_shingles", "key")
        .join(_by_key(nodes, roots).drop("stands"), "key", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 38, rows: int = 5, permutations: int = 96, margin: float = 0.13) -> DataFrame:
    """One row of each component of ``docs``, all columns as they are: the one with the smallest doc_id; of several such rows any one.

    Rows whose text has no words, null ones included, all stay.
    """
    rows_seen, nodes, roots = _resolve(docs, k, percent, bands, rows, permutations, margin)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _key_of()(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    standing = _by_key(nodes, roots).filter("stands").select("key")
    # Copies of a text meet in an aggregate that keeps one of them before rows are dealt.
    copies = rows_seen.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    single = standing.join(copies, "key")
    some = keyed.join(single, "key")
    once = some.filter("n = 1").select("doc")
    several = some.filter("n > 1").groupBy("key").agg(F.min_by("doc", F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"))).alias("doc")).select("doc")
    kept = once.unionByName(several).unionByName(keyed.filter("key is null").select("doc"))
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def _key_of():
    @F.arrow_udf("binary")
    def key(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], ["text"])
        return pa.array([x for part in W.slices(iter([batch]), "text") for x in _keys(W.words_of(*W.utf8(part.column("text"))))], pa.binary())

    return key
