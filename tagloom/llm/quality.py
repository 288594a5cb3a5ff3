"""Quality by naive Bayes support vectors.

Indicators of word n-grams (single words, pairs, and runs of four word shapes) are scaled by their class log-count ratios, counted over all labelled
rows outside the held-out fold; a linear model with hinge loss is then fitted to them by dual coordinate descent on a bounded
sample of those rows. A logistic calibration on rows that neither step saw turns margins into scores.

Indicators fall into a table of fixed size (hash buckets), which bounds what is gathered and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.llm.labelled import counted, dense, fold, labelled, logistic, probability

U = np.uint64
BUCKETS = 1 << 20
FIT_ROWS = 8_192  # expected rows of the sample that the linear model is fitted to
CALIBRATION_ROWS = 8_192
EPOCHS = 20
_KIND = np.zeros(256, np.uint8)  # other signs 0, lower case 1, capital 2, digit 3, beyond ASCII 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of each text."""
    data, offsets = W.utf8(texts)
    words = W.words_of(data, offsets, fold=False)
    h, first = words.hashes, words.first
    same = np.zeros(len(h), np.uint8)
    same[1:] = h[1:] == h[:-1]
    shape = W.mix((_KIND[data[words.starts]] * U(10) + _KIND[data[words.ends - 1]] * U(2) + same).astype(U) + U(977)) if len(h) else h
    kinds = [(W.mix(h ^ U(1)), 1), (W.grams(h, 2), 2), (W.grams(shape, 4), 4)]
    buckets = [((g % U(BUCKETS)).astype(np.int32), n) for g, n in kinds]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield W.distinct(np.concatenate([g[a : max(a, b - n + 1)] for g, n in buckets]))


def _places(batch: pa.RecordBatch):
    for part in W.slices(iter([batch]), "text"):
        labels = part.column("label").to_numpy()
        for found, label in zip(indicators(part.column("text")), labels.tolist()):
            yield found.astype(np.int64) + int(label) * BUCKETS, None


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        found = [f.tobytes() for f in indicators(batch.column("text"))]
        yield pa.record_batch([batch.column("label"), pa.array(found, pa.binary())], ["label", "found"])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights over buckets of the hinge-loss model on rows of unit length whose values are the buckets' ratios.

    Each step solves the dual for one row exactly: ``a = clip(a - (y w.x - 1), 0, cost)``.
    """
    weights, a = np.zeros(len(ratio)), np.zeros(len(rows))
    signs = np.where(labels > 0, 1.0, -1.0)
    values = []
    for found in rows:
        x = ratio[found].astype(np.float64)
        length = np.sqrt(x @ x)
        values.append(x / length if length else x)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            found, x = rows[i], values[i]
            if not len(x):
                continue
            new = min(cost, max(0.0, a[i] - (signs[i] * (weights[found] @ x) - 1)))
            if new != a[i]:
                weights[found] += (new - a[i]) * signs[i] * x
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return weights


@dataclass
class Model:
    """Per bucket the ratio and the product of weight and ratio, and the calibration."""

    ratio: np.ndarray
    weight: np.ndarray
    calibration: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = []
        for found in indicators(texts):
            x = self.ratio[found].astype(np.float64)
            length = np.sqrt(x @ x)
            out.append(self.weight[found].sum(dtype=np.float64) / length if length else 0.0)
        return np.array(out)


def _sample(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, chosen by a hash of their text."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside fold ``held_out``. Labels, language, source and id are no inputs of a score."""
    rows = labelled(docs, labels, label).withColumn("fold", fold(F.col("doc_id"), folds)).filter(F.col("fold") != held_out)
    rows = rows.withColumn("part", (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)) == 0).cast("int"))
    fit, rest = rows.filter("part = 0").select("text", "label"), rows.filter("part = 1").select("text", "label")
    counts = dense(fit.mapInArrow(counted(2 * BUCKETS, _places), "place long, n double"), 2 * BUCKETS).reshape(2, BUCKETS) + 1.0
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio = ratio.astype(np.float32)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    got = _sample(fit, sizes.get(0, 0), fit_rows, 17).mapInArrow(_rows_of, "label int, found binary").toArrow()
    weights = dual_descent([np.frombuffer(found.as_buffer(), np.int32) for found in got["found"]], got["label"].to_numpy(), ratio)
    model = Model(ratio, (weights * ratio).astype(np.float32), np.zeros(2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            yield pa.record_batch([batch.column("label"), pa.array(shared.value.margins(batch.column("text")))], ["label", "margin"])

    seen = _sample(rest, sizes.get(1, 0), CALIBRATION_ROWS, 23).mapInArrow(margin, "label int, margin double").toArrow()
    model.calibration = logistic(seen["margin"].to_numpy()[:, None], seen["label"].to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Empty and null texts get the score of no evidence; long texts are read whole; repeated rows score alike; other columns are ignored.
    An empty table gives an empty one; without labelled rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            scores = probability(shared.value.margins(batch.column("text"))[:, None], shared.value.calibration)
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(apply, "doc_id long, score double, predicted int")
