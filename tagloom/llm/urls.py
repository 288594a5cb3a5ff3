"""URL filters: rules by host and path, and a ratio of character models for what no rule decides.

The urls that rules allow and block train two variable-order Markov models over the characters of host and path: each order's
estimate is smoothed towards the next shorter context, ``P_k = (n(context, c) + STRENGTH * P_k-1) / (n(context) + STRENGTH)``. A url
is judged by the length-normalised difference of its log-likelihoods, against a threshold calibrated on a fold of the decided urls that the counts do not use.
Counts cover all decided urls and lie in a table of fixed size (hash buckets).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.llm.labelled import counted, dense, logistic, probability

U = np.uint64
ORDER = 5
BUCKETS = 1 << 20
STRENGTH = 2.0
CALIBRATION_ROWS = 20_000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host or one of its parent domains and begins the path, as ``struct(rule, verdict)``; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0 (no context) up: buckets of the grams that end at each character, and which lie in one text.

    Every text is closed by an end sign. First comes (text number of each character, number of characters of each text).
    """
    data, offsets = W.utf8(texts)
    n = np.diff(offsets)
    ends = np.cumsum(n + 1) - 1
    symbols = np.full(len(data) + len(n), 256, np.int64)
    own = np.ones(len(symbols), bool)
    own[ends] = False
    symbols[own] = data
    begin = np.repeat(ends - n, n + 1)
    place = np.arange(len(symbols)) - begin
    yield np.repeat(np.arange(len(n)), n + 1), n + 1
    hashed = W.mix(symbols.astype(U) + U(1))
    for k in range(1, ORDER + 2):
        grams = np.zeros(len(symbols), U)
        if len(symbols) >= k:
            grams[k - 1 :] = W.grams(hashed, k)
        yield (W.mix(grams + U(k)) % U(BUCKETS - 1) + U(1)).astype(np.int64), place >= k - 1


def _places(batch: pa.RecordBatch):
    for part in W.slices(iter([batch]), "address"):
        steps = _grams(part.column("address"))
        owner, _ = next(steps)
        base = (part.column("label").to_numpy().astype(np.int64) * BUCKETS)[owner]
        yield base, None  # bucket 0: all characters
        for buckets, inside in steps:
            yield (base + buckets)[inside], None


@dataclass
class Model:
    """Gram counts of blocked (0) and allowed (1) urls and the calibration of their difference."""

    counts: np.ndarray
    calibration: np.ndarray

    def differences(self, texts: pa.Array) -> np.ndarray:
        steps = _grams(texts)
        owner, sizes = next(steps)
        p = [np.full(len(owner), 1 / 257), np.full(len(owner), 1 / 257)]
        before, usable = None, None
        for buckets, inside in steps:
            for c in (0, 1):
                context = np.full(len(owner), self.counts[c, 0]) if before is None else np.roll(self.counts[c][before], 1)
                estimate = (self.counts[c][buckets] + STRENGTH * p[c]) / (context + STRENGTH)
                p[c] = np.where(inside, np.minimum(estimate, 1), p[c])
            before = buckets
        total = np.zeros(len(sizes))
        np.add.at(total, owner, np.log(p[1]) - np.log(p[0]))
        return total / sizes


def train(decided: DataFrame) -> Model:
    """Fit on rows ``(address, label)``: label 1 for allowed. A fifth of them, by a hash of the address, calibrates."""
    rows = decided.withColumn("part", F.pmod(F.xxhash64("address", F.lit(5)), F.lit(5)))
    counts = dense(rows.filter("part > 0").select("address", "label").mapInArrow(counted(2 * BUCKETS, _places), "place long, n double"), 2 * BUCKETS)
    model = Model(counts.reshape(2, BUCKETS), np.zeros(2))
    shared = decided.sparkSession.sparkContext.broadcast(model)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "address"):
            yield pa.record_batch([batch.column("label"), pa.array(shared.value.differences(batch.column("address")))], ["label", "difference"])

    held = rows.filter("part = 0").withColumn("h", F.xxhash64("address", F.lit(6))).orderBy("h").limit(CALIBRATION_ROWS).select("address", "label")
    seen = held.mapInArrow(difference, "label int, difference double").toArrow()
    model.calibration = logistic(seen["difference"].to_numpy()[:, None], seen["label"].to_numpy())
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score.

    ``score`` is the calibrated chance of being allowed, also where a rule decides. Without urls that rules allow and block it is 0.5 and such urls are allowed. Null and broken
    urls have empty host and path and are judged by the models like others. Repeated rows come out alike; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parted.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("r"), F.concat("host", "path").alias("address"))
    model = train(ruled.filter(F.col("r").isNotNull()).select("address", (F.col("r.verdict") == "allow").cast("int").alias("label")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(addresses: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in addresses:
            batch = pa.record_batch([column], ["address"])
            parts = [probability(shared.value.differences(part.column("address"))[:, None], shared.value.calibration) for part in W.slices(iter([batch]), "address")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    scored = ruled.withColumn("score", score("address"))
    by_method = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_method).alias("verdict"), "score")
