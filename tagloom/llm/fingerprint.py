"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; normalised chunking asks for more zero bits before the usual chunk size than after it,
so chunk sizes gather around it and an edit moves boundaries only nearby. A fingerprint lists the chunks' digests and lengths; the likeness of two
is the weight of their common chunks over that of the lighter one (containment), weights being lengths.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W

U = np.uint64
LEAST, USUAL, MOST = 24, 64, 256  # bytes of a chunk
STRICT, LOOSE = U(0x7F) << U(25), U(0x1F) << U(25)  # 7 and 5 bits of the 32-byte hash
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint64)
PART_ROWS = 5_000  # documents of one range, on average


def _gear(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes up to each place: the sum of ``GEAR[byte] << distance``, by doubling, modulo 2**32."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << U(shift))
    return h & U(0xFFFFFFFF)


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (32 bits) and lengths of the chunks of one text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0].tolist()
    loose = loose.tolist()
    cuts, at = [0], 0
    while at < n:
        if n - at <= LEAST:
            at = n
        else:
            i = bisect.bisect_left(strict, at + LEAST)
            if i < len(strict) and strict[i] < at + USUAL:
                at = strict[i]
            else:
                i = bisect.bisect_left(loose, at + USUAL)
                at = min(n, loose[i] if i < len(loose) and loose[i] < at + MOST else at + MOST)
        cuts.append(at)
    edges = np.array(cuts)
    digests = W.span_hash(W.running(data), edges[:-1], edges[1:])
    return (digests >> U(32)).astype(np.int64), np.diff(edges)


def fingerprint(found: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{d:08x}{n:x}" for d, n in zip(found[0].tolist(), found[1].tolist()))


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Length of the common chunks over that of the fingerprint with fewer bytes in distinct chunks; 1 for two empty ones, 0 for one."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    a, b = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (x, y))
    common = sum(n for d, n in a.items() if b.get(d) == n)
    return common / min(sum(a.values()), sum(b.values()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, each in order and closed by an echo of the document that follows it."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    as_batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    cut = lambda text: chunks(np.frombuffer(text.encode(), np.uint8))
    last, out, size = None, [], 0
    for batch in W.slices(batches, "text"):
        for part, doc_id, text, echo in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "echo"))):
            found = cut(text)
            if last is not None and last[0] == part:
                _, own_id, own, own_found = last
                n = len(own)
                edited = own[: n - n // 4] + text[: n // 4]
                edited_found = cut(edited)
                out.append((own_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own_found), fingerprint(edited_found), likeness(own_found, edited_found), likeness(own_found, found)))
                size += n
            last = None if echo else (part, doc_id, text, found)
            if size > 1 << 22:
                yield as_batch(out)
                out, size = [], 0
    if out:
        yield as_batch(out)


def fingerprints(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``docs`` needs doc_id and text; other columns are ignored. Null texts are empty. The next document is that with the next doc_id (null last; equal
    ids by text), after the last one the first; alone, a document follows itself. The edited text has its last ``n_chars // 4`` code points replaced by as many (or all) of the next text.

    Documents are dealt into id ranges whose bounds are ids of the table, each range with an echo of the one after it, so text moves once and no range depends on
    another task. Equal ids share a range, which streams through its task.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    facts = plain.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("first")).first()
    parts = min(20_000, max(1, facts["n"] // part_rows))
    shares = [i / parts for i in range(1, parts)]
    bounds = plain.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("b")).first()["b"] if shares and facts["ids"] else []
    bounds = sorted(set(bounds or []) - {facts["first"]})
    nulls = facts["n"] > facts["ids"]
    last = len(bounds) + (1 if nulls and facts["ids"] else 0)  # ids that are null have a range of their own, the last
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        values = np.searchsorted(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, values).astype(np.int32))

    own = plain.withColumn("part", part_of("doc_id")).withColumn("echo", F.lit(False))
    # The smallest text of each bound id opens its range; an echo of it closes the range before, and one of the very first row the last range.
    starts = F.col("doc_id") == facts["first"] if facts["first"] is not None else F.col("doc_id").isNull()
    opening = own.filter(starts).withColumn("part", F.lit(last))
    if bounds:
        opening = opening.unionByName(own.filter(_among(shared)(F.col("doc_id"))).withColumn("part", F.col("part") - 1))
    if nulls and facts["ids"]:
        opening = opening.unionByName(own.filter(F.col("doc_id").isNull()).groupBy("doc_id").agg(F.min("text").alias("text"), F.lit(last - 1).alias("part"), F.lit(False).alias("echo")))
    echoes = opening.groupBy("part").agg(F.min(F.struct("text", "doc_id")).alias("e")).select("e.doc_id", "e.text", "part", F.lit(True).alias("echo"))
    dealt = own.unionByName(echoes).repartition(max(1, -(-(last + 1) // 4)), "part").sortWithinPartitions("part", "echo", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "doc_id", "text", "echo").mapInArrow(_rows, schema)


def _among(shared):
    @F.arrow_udf("boolean")
    def among(ids: pa.Array) -> pa.Array:
        return pa.array(np.isin(ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), shared.value))

    return among
