"""Repeated passages by column-wise construction over a collection of aligned windows.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well. A suffix array of all
documents together would need one round per byte of the longest document, each over the whole corpus.
Here documents are first cut into short members of a collection whose rounds are bounded:

1. In each run of ``length - gram + 1`` neighbouring byte grams the least hash (the leftmost of equals) is an *anchor*. Equal
   strings have their anchor at equal offsets, so two occurrences always meet under the anchor's hash.
2. Anchors whose hash occurs once are dropped. The others give a member: the ``2 * length - gram`` bytes around the anchor.
   Members are dealt by anchor hash.
3. In each block, columns are inserted from the right, one symbol of every member each round. A round sorts
   the members stably by the new symbol, which is the Burrows-Wheeler step (the column read in the order so far is the
   transform's column), and renews the common prefixes of neighbours by range minima over the previous ones.
   Only two columns are held; members come from Spark's sorted shuffle files one block after the other.
4. A member whose common prefix with a neighbour reaches ``length`` starts a repeated string there.

A group with more members than ``hot`` is parted until its parts fit a block, and these take step 3 like all others. Strings
that start in one half of the columns have the bytes from the half's last column to ``length`` behind its first in common, so members
that differ there cannot share one: each half deals the members anew by those bytes. Members that are equal in all bytes that
count are found by a partial aggregate first and one of them stays, so in the end, at one column, a part holds a single member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.session import materialize

U = np.uint64
BLOCK = 16_384  # members whose columns are inserted together
STRIDE = 1 << 23  # positions whose sliding minima are taken at once
_PLACE = U((1 << 24) - 1)


def _anchors(sums: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all texts of a slice."""
    n = int(offsets[-1])
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - gram + 1)
    hashes = W.span_hash(sums, at, at + gram)
    width = length - gram + 1
    usable = np.ones(n - length + 1, bool)  # windows that stay inside one text
    for edge in offsets[1:-1].tolist():
        usable[max(0, edge - length + 1) : edge] = False
    found = []
    for base in range(0, len(usable), STRIDE):
        part = hashes[base : base + STRIDE + width - 1]
        keys = np.full(-(-len(part) // width) * width, ~U(0))
        keys[: len(part)] = (part & ~_PLACE) | np.arange(len(part), dtype=U)
        table = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = len(part) - width + 1
        least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _PLACE).astype(np.int64) + base
        least = least[usable[base : base + count]]
        found.append(least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least)
    places = np.concatenate(found)
    places = places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places
    return places, hashes[places]


def anchor_rows(length: int, gram: int):
    """A batch function: k, text -> h, k, at: one row per anchor."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            data, offsets = W.utf8(batch.column("text"))
            places, hashes = _anchors(W.running(data), offsets, length, gram)
            owner = np.searchsorted(offsets, places, side="right") - 1
            yield pa.record_batch(
                [pa.array(hashes.view(np.int64)), batch.column("k").take(pa.array(owner)), pa.array((places - offsets[owner]).astype(np.int32))],
                ["h", "k", "at"],
            )

    return apply


def _lasting(at: int, c0: int, c1: int, side: int, length: int) -> tuple[int, int] | None:
    """Bytes of the text covered by all whole strings of a member, None where it has none."""
    last = min(side, c1 - length)
    return (at + c0, at + last + length) if last >= c0 else None


MEMBER = "h long, k long, at long, c0 int, c1 int, hot boolean, member binary, s long, e long"
HALF = "h long, k long, at long, c0 int, c1 int, a int, b int, member binary"


def member_rows(length: int, gram: int):
    """A batch function: k, text, marks (2 * place + hot) -> members, and spans already known to repeat inside one text.

    ``at`` is the place of the member's first column in its text (negative where the text starts later); columns ``c0`` to ``c1`` hold its
    bytes. Equal members of one text repeat each other: one stays to meet those of other texts.
    """
    side, width = length - gram, 2 * length - gram
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("c0", pa.int32()), ("c1", pa.int32()), ("hot", pa.bool_()), ("member", pa.binary()), ("s", pa.int64()), ("e", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in W.slices(batches, "text"):
            for k, text, marks in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist()):
                seen: dict[tuple, int] = {}
                for mark in sorted(marks):
                    place, hot = mark >> 1, bool(mark & 1)
                    at = place - side
                    c0, c1 = max(0, -at), min(width, len(text) - at)
                    member = bytes(c0) + text[at + c0 : at + c1] + bytes(width - c1)
                    first = seen.setdefault((c0, c1, member), at)
                    if first == at:
                        h = int.from_bytes(hashlib.blake2b(text[place : place + gram], digest_size=8).digest(), "little", signed=True)
                        rows.append((h, k, at, c0, c1, hot, member, None, None))
                    else:
                        for start in (first, at):
                            span = _lasting(start, c0, c1, side, length)
                            if span:
                                rows.append((None, k, None, None, None, None, None, *span))
                if len(rows) >= 4096:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return apply


def repeated_starts(table: np.ndarray, c0: np.ndarray, c1: np.ndarray, length: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Column by column from the right: the rows of ``table`` whose ``length`` bytes from that column on another row has as well.

    ``table`` has one member per row, with bytes in columns ``c0`` to ``c1``. Yields (column, row numbers) for columns up to ``last``.
    """
    count, width = table.shape
    columns = np.ascontiguousarray(table.T)
    order, shared = np.arange(count), np.zeros(count + 1, np.int32)  # shared[i]: common prefix of the i-th member with the one before
    for column in range(width - 1, -1, -1):
        symbols = columns[column][order]
        step = np.argsort(symbols, kind="stable")
        least = np.minimum.reduceat(shared, step + 1)
        order, symbols = order[step], symbols[step]
        inside = (column >= c0[order]) & (column < c1[order])
        joined = (symbols[1:] == symbols[:-1]) & inside[1:] & inside[:-1]
        shared = np.zeros(count + 1, np.int32)
        shared[1:count] = np.where(joined, least[:-1] + 1, 0)
        if column <= last:
            long = shared >= length
            rows = order[long[:-1] | long[1:]]
            if len(rows):
                yield column, rows


def _block_spans(members: list[bytes], k: np.ndarray, at: np.ndarray, c0: np.ndarray, c1: np.ndarray, length: int, side: int) -> pa.RecordBatch:
    table = np.frombuffer(b"".join(members), np.uint8).reshape(len(members), -1)
    hit = np.zeros((len(members), side + 1), bool)
    for column, rows in repeated_starts(table, c0, c1, length, side):
        hit[rows, column] = True
    edge = np.zeros((len(members), side + 3), np.int8)
    edge[:, 1:-1] = hit
    change = np.diff(edge, axis=1)
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]  # one past the last start
    return pa.record_batch([pa.array(k[row]), pa.array(at[row] + begin), pa.array(at[row] + end - 1 + length)], ["k", "s", "e"])


def block_rows(length: int, gram: int):
    """A batch function over members sorted by ``h``: -> k, s, e, the spans found block by block. A group is never cut."""
    side = length - gram

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts):
            t = pa.Table.from_batches(parts)
            if t.num_rows > 1:
                yield _block_spans(t["member"].to_pylist(), *(t[c].to_numpy() for c in ("k", "at", "c0", "c1")), length, side)

        for batch in batches:
            h = batch.column("h").to_numpy()
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            at = 0
            while at < len(h):
                room = BLOCK - sum(b.num_rows for b in held)
                if held and room <= 0 and held[-1].column("h")[-1].as_py() != h[at]:
                    yield from flush(held)
                    held, room = [], BLOCK
                later = ends[(ends > at) & (ends - at >= room)]
                end = int(later[0]) if len(later) else len(h)
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from flush(held)

    return apply


def half_rows(length: int, gram: int):
    """A batch function: members and the columns ``a`` to ``b`` (not included) where their strings start -> the same for both halves of these columns.

    ``h`` becomes the hash of the bytes that all strings of a half hold. Columns that none of them reaches are blanked, so that ``c0`` and ``c1`` leave
    no other strings; a member without whole strings in a half has no row there.
    """
    width = 2 * length - gram
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("c0", pa.int32()), ("c1", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("member", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "member"):
            rows: list[tuple] = []
            for k, at, c0, c1, a, b, member in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "c0", "c1", "a", "b", "member"))):
                middle = (a + b) // 2
                for low, high in ((a, middle), (middle, b)):
                    begin, end = max(c0, low), min(c1, high - 1 + length)
                    if low < high and end - begin >= length:
                        place = low.to_bytes(4, "little") + high.to_bytes(4, "little")
                        h = int.from_bytes(hashlib.blake2b(member[high - 1 : low + length], digest_size=8, salt=place).digest(), "little", signed=True)
                        rows.append((h, k, at, begin, end, low, high, bytes(begin) + member[begin:end] + bytes(width - end)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return apply


def parted(members: DataFrame, length: int, gram: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """``members (h, k, at, c0, c1, member)`` of large groups as groups of up to ``hot`` for the blocks, and the spans (k, s, e) of equal members.

    The columns are halved as often as it takes, at most log2 of their number times; a group of one column has no two different members.
    """
    groups, spans = [], []
    rows = members.withColumns({"a": F.lit(0), "b": F.lit(length - gram + 1)})
    same = ["h", "c0", "c1", "a", "b", "member"]
    while not rows.isEmpty():
        # Written, both are plain sides of joins, of which Spark can split what a frequent member or group brings to one partition.
        met = materialize(rows.groupBy(*same).agg(F.min(F.struct("k", "at")).alias("first"), F.count("*").alias("n")), "met")
        sizes = materialize(met.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        whole = rows.join(met.filter("n > 1").select(*same), same, "left_semi").filter(F.col("c1") - F.col("c0") >= length)
        spans.append(whole.select("k", (F.col("at") + F.col("c0")).alias("s"), (F.col("at") + F.col("c1")).alias("e")))
        left = met.select(*same, "first.k", "first.at").join(sizes, "h")
        fits = (F.col("size") <= hot) | (F.col("b") - F.col("a") == 1)
        groups.append(left.filter(fits).select("h", "k", "at", "c0", "c1", "member"))
        rows = materialize(left.filter(~fits).select("k", "at", "c0", "c1", "a", "b", "member").mapInArrow(half_rows(length, gram), HALF), "halves")
    return groups, spans


def _text_key(column: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit("")))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 20_000) -> DataFrame:
    """Rows ``(k, spans, whole)`` per distinct text with repeated strings: ``spans`` is a flat array of starts and ends in bytes, not yet merged.

    ``k`` is ``xxhash64`` of the text. ``whole`` marks texts that occur in several rows and have ``length`` bytes or more: all of them goes.
    Two texts that share their 64-bit key would be taken for copies (a chance of 3e-8 among 10**6 texts).
    Null texts are empty; an empty table gives an empty one.
    """
    if not 0 < gram <= length < 1 << 20:
        raise ValueError("0 < gram <= length is needed")
    plain = docs.select(_text_key().alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_ones = plain.filter(F.octet_length("text") >= length)
    anchors = materialize(long_ones.mapInArrow(anchor_rows(length, gram), "h long, k long, at int"), "anchors")
    # How often a hash occurs: a partial aggregate, so that a passage of a third of all texts is combined before it is dealt.
    # Written, it is a plain side of the join, of which Spark can split the partition of such a passage.
    counts = anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > hot).cast("int").alias("hot"))
    counts = materialize(counts, "counts")
    marks = anchors.join(counts, "h").groupBy("k").agg(F.collect_set(F.col("at").cast("long") * 2 + F.col("hot")).alias("marks"))
    # One row per distinct text: copies meet in a partial aggregate.
    texts = long_ones.groupBy("k").agg(F.first("text").alias("text"))
    members = materialize(texts.join(marks, "k").select("k", "text", "marks").mapInArrow(member_rows(length, gram), MEMBER), "members")
    columns = ["h", "k", "at", "c0", "c1", "member"]
    cold, warm = members.filter("member is not null and not hot").select(*columns), members.filter("member is not null and hot").select(*columns)
    groups, equal = parted(warm, length, gram, hot)
    for group in groups:
        cold = cold.unionByName(group)
    spans = cold.repartition("h").sortWithinPartitions("h").mapInArrow(block_rows(length, gram), "k long, s long, e long")
    for more in equal:
        spans = spans.unionByName(more)
    own = members.filter("member is null").select("k", "s", "e")
    listed = spans.unionByName(own).groupBy("k").agg(F.flatten(F.collect_set(F.array("s", "e"))).alias("spans"))
    whole = long_ones.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.lit(True).alias("whole"))
    return materialize(listed.join(whole, "k", "full_outer"), "spans")


def _merged(spans: np.ndarray | None, whole: bool, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs in order."""
    if whole is True and size >= length:
        return [(0, size)]
    if spans is None or len(spans) == 0:
        return []
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return list(zip(pairs[fresh, 0].tolist(), reach[np.append(fresh[1:] - 1, len(pairs) - 1)].tolist()))


def _runs_kept(text: bytes, gone: list[tuple[int, int]]) -> list[bytes]:
    edges = [0, *(x for pair in gone for x in pair), len(text)]
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2])]


def _digest(length: int):
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<bigint>")
    def digest(texts: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = []
        for text, marks, all_of_it in zip(texts, spans, whole):
            raw = (text or "").encode()
            gone = _merged(marks, all_of_it, len(raw), length)
            kept = hashlib.sha256()
            for run in _runs_kept(raw, gone):
                kept.update(run)
            out.append((len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [x for pair in gone for x in pair]))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return digest


def _kept_text(length: int):
    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for text, marks, all_of_it in zip(texts, spans, whole):
            raw = (text or "").encode()
            gone = _merged(marks, all_of_it, len(raw), length)
            out.append(b"".join(run.decode("utf-8", "ignore").encode() for run in _runs_kept(raw, gone)).decode() if gone else text)
        return pd.Series(out, dtype=object)

    return kept


def _with_spans(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _text_key().alias("k"))
    return rows.join(repeated_spans(docs, length, gram, hot), "k", "left")


def dedup_report(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``removed`` (flat starts and ends of the maximal runs, in bytes of the original).

    Strings are judged on the input, not on what is left. Null and empty texts have 0 bytes and the digest of nothing. Repeated rows repeat each other.
    """
    found = _with_spans(docs, length, gram, hot).select(F.col("doc.doc_id").alias("doc_id"), _digest(length)(F.col("doc.text").cast("string"), "spans", "whole").alias("d"))
    return found.select("doc_id", "d.*")


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 20_000) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; all other columns as they are.

    A character of which only some bytes lie in a removed run is left out as a whole. Null texts stay null.
    """
    rows = _with_spans(docs, length, gram, hot)
    text = _kept_text(length)(F.col("doc.text").cast("string"), "spans", "whole")
    return rows.select(*(text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
