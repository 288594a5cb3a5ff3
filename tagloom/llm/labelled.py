"""What the learned operators share: labelled rows, folds, logistic calibration, dense tables summed by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_LABELS = 4_000_000  # rows of two numbers: below 100 MB, the most that is broadcast
CHUNK = 8192


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows ``(doc_id, text, label)`` of documents with a label of 0 or 1. Of several labels of one id the greatest counts.

    Labels are two numbers a row: up to MAX_LABELS rows, counted first, they are broadcast so that no text is moved; beyond, the join shuffles.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    if labels.count() <= MAX_LABELS:
        marks = F.broadcast(marks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(marks, "doc_id")


def dense(rows: DataFrame, size: int, kind: type = np.float32) -> np.ndarray:
    """``rows (place, n)`` summed into one array of ``size`` values of ``kind``, which bounds what reaches the driver.

    Sums are packed into chunks by tasks, so the driver gets a few thousand rows of bytes.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        values = np.zeros(CHUNK, np.float64)
        values[table["place"].to_numpy() % CHUNK] = table["total"].to_numpy()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([values.astype(kind).tobytes()], pa.binary())})

    summed = rows.groupBy("place").agg(F.sum("n").cast("double").alias("total"))
    packed = summed.groupBy(F.floor(F.col("place") / CHUNK).alias("chunk")).applyInArrow(pack, "chunk long, packed binary")
    out = np.zeros(-(-size // CHUNK) * CHUNK, kind)
    for chunk, values in packed.toLocalIterator():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(values, kind)
    return out[:size]


def counted(size: int, places: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]]):
    """A batch function that sums (places, weights) of a whole partition in one array and yields what is not zero: place, n."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in batches:
            for at, weight in places(batch):
                np.add.at(total, at, 1 if weight is None else weight)
        at = np.flatnonzero(total)
        for begin in range(0, len(at), 1 << 16):
            part = at[begin : begin + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int64)), pa.array(total[part])], ["place", "n"])

    return apply


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton steps; all zero without rows."""
    x = np.column_stack((features, np.ones(len(features))))
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


def probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
