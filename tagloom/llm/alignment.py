"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often tokens of both meet.

A text is cut into pieces before single blanks between words, where neither tokenizer has a token across, so pieces of a very long text are
encoded by different tasks. Tokens of a byte range form a fragment: an open prefix (up to the first byte offset at which tokens of both end), closed
groups, and an open suffix. Two neighbours compose to a fragment again: the left suffix and the right prefix close to a group. Composition is
associative, so fragments of a long text are reduced in a tree, eight neighbours a step, each node in a task of its own; groups leave as soon as they close.

Pairs of token ids are counted over the corpus. The most frequent of them (a bounded number) go to the tasks that hold the links; links of all other pairs are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.session import materialize

PIECE = 1 << 15  # bytes from which a text is cut, and the least size of its pieces
RANGE = 1 << 13  # bytes of a fragment of a long text
HOT_PAIRS = 1 << 20  # pairs in a broadcast: 13 MB
FAN = 8
_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(r"(?<=\S) (?=[A-Za-z])")


class Encoders:
    """Both tokenizers of a task: ids and the byte offsets at which their tokens end."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        model = json.load(open(a_path, encoding="utf-8"))["model"]
        spelled = {self._letter(b): b for b in range(256)}
        ranks = {bytes(spelled[c] for c in token): i for token, i in model["vocab"].items() if all(c in spelled for c in token)}
        special = model["vocab"].keys() & {"<|endoftext|>"}
        for token in special:
            ranks.pop(token.encode(), None)
        merged = [bytes(spelled[c] for c in (m if isinstance(m, str) else "".join(m)) if c != " ") for m in model["merges"]]
        if [ranks[m] for m in merged] != sorted(ranks[m] for m in merged):
            raise ValueError("merges are not in the order of their ids")
        self._a = tiktoken.Encoding("own", pat_str=_WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.a_text = [str(i) for i in range(len(self.a_bytes))]
        self.b_text = [str(i) for i in range(len(self.b_bytes))]
        # a text may be cut before a blank only if no piece has a blank behind another character
        self.may_cut = not any(b" " in t.lstrip(b" ") for t in self.b_bytes)

    @staticmethod
    def _letter(byte: int) -> str:
        """How byte-level vocabularies spell a byte: printable ones as themselves, others from U+0100 up, in order."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(byte) if byte in shown else chr(0x100 + sum(b not in shown for b in range(byte)))

    def _piece(self, i: int) -> bytes:
        if self._b.is_byte(i):
            return bytes([int(self._b.id_to_piece(i)[3:5], 16)])
        if self._b.is_control(i):
            return b""
        return self._b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text, or None where a text is empty or not given back byte for byte."""
        pieces = self._b.encode(texts, num_threads=1)
        for text, b in zip(texts, pieces):
            if not text:
                yield None
                continue
            whole = (" " + text).encode()
            a = self._a.encode_ordinary(" " + text)
            if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
                yield None
            else:
                yield np.array(a, np.int64), np.array(b, np.int64)


def cut_points(text: str, size: int) -> list[int]:
    """Where to cut a text: blanks between two words, at least ``size`` characters apart."""
    cuts, at = [], size
    while at < len(text):
        found = _SAFE.search(text, at)
        if found is None:
            break
        cuts.append(found.start())
        at = found.start() + size
    return cuts


@dataclass
class Fragment:
    """Tokens of a byte range: ids and ends (bytes from the text's start) of both, cut at the offsets where both end.

    ``head`` and ``tail`` are the open prefix and suffix, as pairs of (ids, ends). Without any common end all tokens are in ``head`` and ``closed`` is False.
    """

    head: tuple = ((), (), (), ())
    tail: tuple = ((), (), (), ())
    closed: bool = False


@dataclass
class Groups:
    """Closed groups in text order: tokens of both, and how many of each every group has."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_cuts: np.ndarray = field(default=None)
    b_cuts: np.ndarray = field(default=None)


def fragment_of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, Groups | None]:
    """The fragment of a range's tokens, and the groups closed within it."""
    common, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    if len(common) == 0:
        return Fragment((a, a_ends, b, b_ends)), None
    i, j, p, q = a_at[0] + 1, b_at[0] + 1, a_at[-1] + 1, b_at[-1] + 1
    head, tail = (a[:i], a_ends[:i], b[:j], b_ends[:j]), (a[p:], a_ends[p:], b[q:], b_ends[q:])
    groups = Groups(a[i:p], b[j:q], a_ends[i:p], b_ends[j:q], a_at[1:] + 1 - i, b_at[1:] + 1 - j)
    return Fragment(head, tail, True), groups


def joined(left: tuple, right: tuple) -> tuple:
    return tuple(np.concatenate((np.asarray(x, np.int64), np.asarray(y, np.int64))) for x, y in zip(left, right))


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Groups | None]:
    """Two neighbours as one fragment, and the group that closes between them. Associative; the empty fragment changes nothing."""
    if not left.closed:
        if not right.closed:
            return Fragment(joined(left.head, right.head)), None
        return Fragment(joined(left.head, right.head), right.tail, True), None
    if not right.closed:
        return Fragment(left.head, joined(left.tail, right.head), True), None
    return Fragment(left.head, right.tail, True), one_group(joined(left.tail, right.head))


def one_group(tokens: tuple) -> Groups:
    a, a_ends, b, b_ends = (np.asarray(x, np.int64) for x in tokens)
    return Groups(a, b, a_ends, b_ends, np.array([len(a)]), np.array([len(b)]))


def links_of(groups: Groups, enc: Encoders) -> np.ndarray:
    """Each pair of tokens with overlapping bytes as ``a * size of B + b``."""
    a_starts, b_starts = groups.a_ends - enc.a_length[groups.a], groups.b_ends - enc.b_length[groups.b]
    first = np.searchsorted(groups.b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, groups.a_ends, side="left") - first
    owner = np.repeat(np.arange(len(n)), n)
    other = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    return groups.a[owner] * len(enc.b_length) + groups.b[other]


def spelled(groups: Groups, enc: Encoders) -> str:
    """``a1,a2|b1;a3|b2,b3`` for groups in order."""
    a, b = [enc.a_text[i] for i in groups.a.tolist()], [enc.b_text[i] for i in groups.b.tolist()]
    out, i, j = [], 0, 0
    for p, q in zip(groups.a_cuts.tolist(), groups.b_cuts.tolist()):
        out.append((a[i] if p == i + 1 else ",".join(a[i:p])) + "|" + (b[j] if q == j + 1 else ",".join(b[j:q])))
        i, j = p, q
    return ";".join(out)


def _encoders(a_path: str, b_path: str) -> Encoders:
    key = (a_path, b_path)
    if key not in _loaded:
        _loaded[key] = Encoders(*key)
    return _loaded[key]


_loaded: dict[tuple[str, str], Encoders] = {}


def _pairs(links: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct pairs as differences of their sorted values, and how often each occurs."""
    values, n = np.unique(links, return_counts=True)
    return np.diff(values, prepend=0).astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes()


def _read_pairs(pairs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(pairs, np.uint32).astype(np.int64)), np.frombuffer(counts, np.uint32).astype(np.int64)


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
#: Rows of long texts: ``kind`` 0 is a fragment (``head``, ``tail``, ``closed``), 1 closed groups, 2 a piece that is not given back byte for byte.
_LONG = (
    "row long, doc_id long, kind int, at long, closed boolean, head binary, tail binary, "
    "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, counts binary"
)


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in names.split(", "))]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _pack(tokens: tuple) -> bytes:
    arrays = [np.asarray(x, np.int64) for x in tokens]
    return np.concatenate(([len(arrays[0]), len(arrays[2])], *arrays)).astype(np.int64).tobytes()


def _unpack(packed: bytes) -> tuple:
    values = np.frombuffer(packed, np.int64)
    n, m = int(values[0]), int(values[1])
    return tuple(np.split(values[2:], [n, 2 * n, 2 * n + m]))


def _closed_row(row: int, doc_id: int | None, groups: Groups, enc: Encoders) -> tuple:
    links = links_of(groups, enc)
    at = int(groups.a_ends[0] - enc.a_length[groups.a[0]])
    return (row, doc_id, 1, at, None, None, None, len(groups.a), len(groups.b), len(groups.a_cuts), len(links), spelled(groups, enc), *_pairs(links))


def _fragment_row(row: int, doc_id: int | None, at: int, part: Fragment) -> tuple:
    return (row, doc_id, 0, at, part.closed, _pack(part.head), _pack(part.tail), None, None, None, None, None, None, None)


def _short(a_path: str, b_path: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders(a_path, b_path)
        for batch in W.slices(batches, "text"):
            out = []
            rows, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            for row, doc_id, pair in zip(rows, ids, enc.encode(texts)):
                if pair is None:
                    out.append((row, doc_id, 0, 0, 0, 0, "", b"", b""))
                    continue
                a, b = pair
                a_ends, b_ends = np.cumsum(enc.a_length[a]), np.cumsum(enc.b_length[b])
                _, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
                groups = Groups(a, b, a_ends, b_ends, a_at + 1, b_at + 1)
                links = links_of(groups, enc)
                digest = hashlib.sha256(spelled(groups, enc).encode()).hexdigest()
                out.append((row, doc_id, len(a), len(b), len(a_at), len(links), digest, *_pairs(links)))
            yield _batch(_ALIGNED, out)

    return align


def _cut(a_path: str, b_path: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_cut = _encoders(a_path, b_path).may_cut
        for batch in W.slices(batches, "text"):
            out = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                begin, start = 0, 0
                for end in [*(cut_points(text, size) if may_cut else ()), len(text)]:
                    piece = text[begin:end]
                    out.append((row, doc_id, start, piece))
                    begin, start = end + 1, start + 1 + len(piece.encode())
            yield _batch("row long, doc_id long, start long, text string", out)

    return cut


def _fragments(a_path: str, b_path: str, span: int):
    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders(a_path, b_path)
        for batch in W.slices(batches, "text"):
            out = []
            rows, ids, starts, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "text"))
            for row, doc_id, start, pair in zip(rows, ids, starts, enc.encode(texts)):
                if pair is None:
                    out.append((row, doc_id, 2, start, *[None] * 10))
                    continue
                a, b = pair
                a_ends, b_ends = start + np.cumsum(enc.a_length[a]), start + np.cumsum(enc.b_length[b])
                # a token belongs to the range in which its last byte lies
                for r in np.unique((np.concatenate((a_ends, b_ends)) - 1) // span).tolist():
                    i, p = np.searchsorted(a_ends, (r * span + 1, (r + 1) * span + 1))
                    j, q = np.searchsorted(b_ends, (r * span + 1, (r + 1) * span + 1))
                    part, groups = fragment_of(a[i:p], a_ends[i:p], b[j:q], b_ends[j:q])
                    out.append(_fragment_row(row, doc_id, max(r * span, start), part))
                    if groups is not None and len(groups.a_cuts):
                        out.append(_closed_row(row, doc_id, groups, enc))
            yield _batch(_LONG, out)

    return fragments


def _node(a_path: str, b_path: str, root: bool):
    """Composes neighbouring fragments; at the root the prefix is the first group, for a text begins where tokens of both do."""

    def node(key: tuple, table: pa.Table) -> pa.Table:
        enc = _encoders(a_path, b_path)
        table = table.sort_by("at")
        row, doc_id, first = (table[c][0].as_py() for c in ("row", "doc_id", "at"))
        total, out = Fragment(), []
        for closed, head, tail in zip(*(table[c].to_pylist() for c in ("closed", "head", "tail"))):
            total, groups = compose(total, Fragment(_unpack(head), _unpack(tail), closed))
            if groups is not None:
                out.append(_closed_row(row, doc_id, groups, enc))
        out.append(_closed_row(row, doc_id, one_group(total.head), enc) if root else _fragment_row(row, doc_id, first, total))
        return pa.Table.from_batches([_batch(_LONG, out)])

    return node


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals and digest per row from closed groups sorted by row and place, with constant memory."""
    row, sums, digest, doc_id = None, None, None, None

    def done() -> tuple:
        return (row, doc_id, *sums, digest.hexdigest(), b"", b"")

    for batch in batches:
        out = []
        counts = np.column_stack([batch.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups", "n_links")])
        for i, (r, d, groups) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "groups")))):
            if r != row:
                if row is not None:
                    out.append(done())
                row, doc_id, sums, digest = r, d, np.zeros(4, np.int64), hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(groups.encode())
            sums = sums + counts[i]
        yield _batch(_ALIGNED, [(x[0], x[1], *map(int, x[2:6]), *x[6:]) for x in out])
    if row is not None:
        x = done()
        yield _batch(_ALIGNED, [(x[0], x[1], *map(int, x[2:6]), *x[6:])])


def aligned(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, span: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Two written tables: one row per document row (``row``, doc_id, counts, digest of its groups), and its links as ``row, pairs, counts`` (several rows for long texts).

    Texts of up to ``piece`` bytes are done within their row. Longer ones are cut, encoded piece by piece in tasks of their own, and reduced by the tree; their closed groups
    are hashed as a sorted stream.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    sized = texts.withColumn("size", F.octet_length("text"))
    short = sized.filter(F.col("size") <= piece).select((F.col("row") * 2).alias("row"), "doc_id", "text")
    done = materialize(short.mapInArrow(_short(a_path, b_path), _ALIGNED), "aligned")

    long = sized.filter(F.col("size") > piece)
    pieces = long.select((F.col("row") * 2 + 1).alias("row"), "doc_id", "text").mapInArrow(_cut(a_path, b_path, piece), "row long, doc_id long, start long, text string")
    written = materialize(pieces.repartition("row", "start").mapInArrow(_fragments(a_path, b_path, span), _LONG), "fragments")
    bad = written.filter("kind = 2").select("row", "doc_id").distinct()
    whole = written.join(bad.select("row"), "row", "left_anti")
    parts, closed, block = whole.filter("kind = 0"), [whole.filter("kind = 1")], span
    longest = written.agg(F.max("at")).first()[0] or 0
    while longest:  # the last node holds the whole text
        block *= FAN
        root = block > longest
        keys = ["row", F.floor(F.col("at") / block).alias("block")]
        level = materialize(parts.groupBy(*keys).applyInArrow(_node(a_path, b_path, root), _LONG), "fragments")
        parts = level.filter("kind = 0")
        closed.append(level.filter("kind = 1"))
        if root:
            break
    groups = closed[0]
    for more in closed[1:]:
        groups = groups.unionByName(more)
    ordered = groups.select("row", "doc_id", "at", "n_a", "n_b", "n_groups", "n_links", "groups").repartition("row").sortWithinPartitions("row", "at")
    zero = F.lit(0).cast("long")
    nothing = bad.select("row", "doc_id", *(zero.alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.lit("").alias("groups_sha256"))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = done.select(*kept).unionByName(ordered.mapInArrow(_digests, _ALIGNED).select(*kept)).unionByName(nothing)
    return rows, done.select("row", "pairs", "counts").unionByName(groups.select("row", "pairs", "counts"))


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """``pair, n, best``: how many links of the corpus hold a pair, and whether no pair of its B id has more. Written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            distinct, at = np.unique(np.concatenate(values), return_inverse=True)
            return distinct, np.bincount(at, weights=np.concatenate(totals), minlength=len(distinct)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            distinct, n = merged()
            for at in range(0, len(distinct), 1 << 16):
                yield pa.record_batch([pa.array(distinct[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["pair", "n"])

        held = 0
        for batch in batches:
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
                v, n = _read_pairs(pairs, counts)
                values.append(v)
                totals.append(n)
                held += len(v)
                if held > 4_000_000:
                    v, n = merged()
                    values, totals, held = [v], [n], 0
                    if len(v) > 2_000_000:
                        yield from rows()
                        values, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield from rows()

    counted = materialize(links.select("pairs", "counts").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair") % b_size
    tops = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # as many rows as B has ids
    return counted.withColumn("b", b).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def link_sums(links: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of rows with links.

    Frequent pairs, up to ``hot_pairs`` of them by classes of powers of two, are looked up where the links lie, which spares them the shuffle and leaves no hot key
    to the join that finds all others.
    """
    classes = {int(c): n for c, n in counts.groupBy(F.floor(F.log2("n")).alias("c")).count().collect()}
    least, room = 64, hot_pairs
    for c in sorted(classes, reverse=True):
        room -= classes[c]
        if room < 0:
            break
        least = c
    is_hot = F.floor(F.log2("n")) >= least
    table = counts.filter(is_hot).toArrow().sort_by("pair").combine_chunks() if least < 64 else None
    hot = tuple(table[c].to_numpy() for c in ("pair", "n", "best")) if table is not None else (np.zeros(0, np.int64),) * 3
    shared = links.sparkSession.sparkContext.broadcast(hot)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            read = [_read_pairs(p, c) for p, c in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist())]
            if not read:
                continue
            owner = np.repeat(np.arange(len(read)), [len(v) for v, _ in read])
            values, times = (np.concatenate(x) for x in zip(*read))
            at = np.minimum(np.searchsorted(pair, values), max(len(pair) - 1, 0))
            hit = pair[at] == values if len(pair) else np.zeros(len(values), bool)
            sums = np.zeros((2, len(read)), np.int64)
            np.add.at(sums[0], owner[hit], (best[at[hit]] if len(pair) else values[hit]) * times[hit])
            np.add.at(sums[1], owner[hit], (n[at[hit]] if len(pair) else values[hit]) * times[hit])
            rows = batch.column("row").to_numpy()
            cold = np.flatnonzero(~hit)
            none = pa.nulls(len(read), pa.int64())
            yield pa.record_batch([pa.array(rows), none, none, pa.array(sums[0]), pa.array(sums[1])], ["row", "pair", "times", "n_best", "count_sum"])
            for i in range(0, len(cold), 1 << 16):
                c = cold[i : i + (1 << 16)]
                zero = pa.array(np.zeros(len(c), np.int64))
                yield pa.record_batch([pa.array(rows[owner[c]]), pa.array(values[c]), pa.array(times[c]), zero, zero], ["row", "pair", "times", "n_best", "count_sum"])

    found = materialize(links.mapInArrow(find, "row long, pair long, times long, n_best long, count_sum long"), "links")
    near = found.filter("pair is null").select("row", "n_best", "count_sum")
    far = found.filter("pair is not null").join(counts.filter(~is_hot), "pair")
    far = far.select("row", (F.col("best") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    return near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, span: int = RANGE, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts and those that either tokenizer does not give back byte for byte have zeros and an empty digest, and no links. Rows with equal or null ids
    stay rows of their own and their links count as often as they occur. Texts of any length take part whole. Other columns are ignored; an empty table gives no rows.
    """
    rows, links = aligned(docs, a_path, b_path, piece, span)
    counts = pair_counts(links, len(_encoders(a_path, b_path).b_length))
    sums = link_sums(links, counts, hot_pairs)
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", n("n_best"), n("count_sum"), "groups_sha256")
