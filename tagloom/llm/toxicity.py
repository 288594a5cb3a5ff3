"""Toxicity by interpolated Kneser-Ney models of words after words, one per class, over a level that the classes share.

Pairs of neighbouring words count once per document. P(word | word before, class) discounts the counts of the pair in the class and backs off to
P(word | class), which discounts the word's continuation count there (the number of different words it follows) and backs off to the shared P(word):
the continuation count over the classes, that is in how many of them the word occurs. Discounts for counts of 1, 2, and 3 or more are estimated from
the counts of counts; a pair that one text of a class has is discounted whole. The weight of backing off is the larger one of the two classes in both, so a word or pair that
neither class knows says nothing, and a context that one class does not know leaves the word to the level below.

A document is described by the length-normalised difference of its toxic and ordinary log-likelihoods, over the whole text and over its worst run of
RUN words, by the pair model and by the level of words below it: pairs learn the labelled texts by heart where these repeat, so a logistic calibration
on a fold of the labelled rows that the counts do not use decides how much each order counts.

Counts of pairs and what each pair adds are exact Spark tables over words, which fill a table of fixed size (hash buckets). What tasks get is bounded: a ratio per
word bucket, the most frequent pairs (PAIRS at most) and a filter of fixed size over all others. A text's occurrences of those others are joined with their table;
what they add to the text and to its worst run is put in afterwards, so the scores do not depend on how many pairs the tasks hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tagloom.llm import words as W
from tagloom.llm.labelled import MAX_LABELS, counted, dense, fold, labelled, logistic, probability
from tagloom.session import materialize

U = np.uint64
WORD_BITS = 21
WORDS = 1 << WORD_BITS
RUN = 3
PAIRS = 1 << 22  # most pairs that tasks hold: 10 bytes each
UNIT = 1 << 24  # what a pair adds is a half float, a whole number of 2**-24: sums do not depend on their order
FILTER_BITS = 26  # 2**26 bits are 8 MB
SHARED_DISCOUNT = 0.75  # of a count of classes, 1 or 2
FEATURES = ["mean", "worst", "pair_mean", "pair_worst"]
CALIBRATION_ROWS = 20_000


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word bucket of every word of the texts, and the first word of each text; bucket 0 is the begin of a text."""
    words = W.words_of(*W.utf8(batch.column("text")), breaks=W.SIGNS)
    now = (words.hashes % U(WORDS - 1)).astype(np.int64) + 1
    before = np.zeros_like(now)
    before[1:] = now[:-1]
    begins = words.first[:-1]
    before[begins[begins < len(now)]] = 0
    return before, now, words.first


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> pair (word before and word in one number), n0, n1: texts of either label with the pair, per slice of text."""
    for batch in W.slices(batches, "text"):
        before, now, first = _pairs(batch)
        n = np.diff(first)
        text = np.repeat(np.cumsum(n > 0), n)
        once = np.unique(text << 2 * WORD_BITS | before << WORD_BITS | now)
        toxic = batch.column("label").to_numpy()[n > 0][(once >> 2 * WORD_BITS) - 1].astype(np.int64)
        pair, at = np.unique(once & ((1 << 2 * WORD_BITS) - 1), return_inverse=True)
        n1 = np.bincount(at, toxic, len(pair)).astype(np.int64)
        yield pa.record_batch([pa.array(pair), pa.array(np.bincount(at, minlength=len(pair)) - n1), pa.array(n1)], ["pair", "n0", "n1"])


def _places(batch: pa.RecordBatch):
    word = batch.column("pair").to_numpy() & (WORDS - 1)
    for label in (0, 1):
        yield label * WORDS + word[batch.column(f"n{label}").to_numpy() > 0], None


@dataclass
class Tables:
    """log P(word | toxic) - log P(word | ordinary) per bucket, and what pairs add to it: the frequent pairs in order with their gains.

    ``others`` is a Bloom filter over all other pairs (None without any), ``least`` and ``most`` are the bounds of what one of them adds.
    """

    ratio: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    others: np.ndarray | None = None
    least: float = 0.0
    most: float = 0.0

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        """Per text and order: mean ratio, and the largest mean ratio of RUN neighbouring words (fewer: of all)."""
        before, now, first = _pairs(batch)
        words = self.ratio[now].astype(np.float64)
        return np.hstack([_described(words, first), _described(words + _gain(self.pairs, before << WORD_BITS | now), first)])

    def opened(self, batch: pa.RecordBatch) -> Opened:
        """The features as far as they are known without the other pairs."""
        before, now, first = _pairs(batch)
        pair, words, n = before << WORD_BITS | now, self.ratio[now].astype(np.float64), np.diff(first)
        values, text = words + _gain(self.pairs, pair), np.repeat(np.arange(len(n)), n)
        is_open = _held(self.others, pair) & ~_found(self.pairs, pair)[1]
        total, opened = (np.concatenate(([0], np.cumsum(x))) for x in (values, is_open))
        starts = np.flatnonzero(text[RUN - 1 :] == text[: max(0, len(text) - RUN + 1)])
        run, k = total[starts + RUN] - total[starts], opened[starts + RUN] - opened[starts]
        sure, settled = np.full((2, len(n)), -np.inf)
        np.maximum.at(sure, text[starts], run + k * self.least)
        np.maximum.at(settled, text[starts[k == 0]], run[k == 0])
        # a run stays open if its other pairs may lift it to the least that the worst run will have
        left = np.flatnonzero((k > 0) & (run + k * self.most >= sure[text[starts]] - 1e-6))
        begin = opened[starts[left]] - opened[first[text[starts[left]]]]
        needed = np.zeros(len(words) + 1, np.int64)
        np.add.at(needed, starts[left], 1)
        np.add.at(needed, starts[left] + RUN, -1)
        at = np.flatnonzero(is_open)
        return Opened(
            _described(words, first), n, total[first[1:]] - total[first[:-1]], settled,
            text[starts[left]], run[left], begin, begin + k[left],
            text[at], pair[at], opened[at] - opened[first[text[at]]], np.cumsum(needed)[at] > 0,
        )


@dataclass
class Opened:
    """Of each text: features by words, number of words, sum of their ratios, and its worst run without other pairs.

    Of each run that may still be the worst: text, sum, and which of the text's other pairs it holds (from, to). Of each other pair: text, pair, number in its text, and whether such a run has it.
    """

    words: np.ndarray
    n: np.ndarray
    total: np.ndarray
    settled: np.ndarray
    run_text: np.ndarray
    run_sum: np.ndarray
    run_begin: np.ndarray
    run_end: np.ndarray
    pair_text: np.ndarray
    pair: np.ndarray
    pair_at: np.ndarray
    pair_needed: np.ndarray


@dataclass
class Model:
    """The tables as tasks get them, the calibration, whether counts and calibration saw both classes, and ``pair, gain`` of the pairs that tasks do not hold."""

    shared: Broadcast
    calibration: np.ndarray
    taught: bool = False
    others: DataFrame | None = None


def _described(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    n = np.diff(first)
    out = np.zeros((len(n), 2))
    out[:, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    out[:, 1] = (total[first[1:]] - total[first[:-1]]) / RUN
    runs = (total[RUN:] - total[:-RUN]) / RUN
    for i in np.flatnonzero(n > RUN).tolist():
        out[i, 1] = runs[first[i] : first[i + 1] - RUN + 1].max()
    return out


def _found(known: tuple[np.ndarray, np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs stand among those known, and whether they do."""
    if not len(known[0]) or not len(pair):
        return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
    distinct, of = np.unique(pair, return_inverse=True)
    at = np.minimum(np.searchsorted(known[0], distinct), len(known[0]) - 1)
    return at[of], (known[0][at] == distinct)[of]


def _gain(known: tuple[np.ndarray, np.ndarray], pair: np.ndarray) -> np.ndarray:
    """What the pairs add to the ratios of their words; 0 for pairs that are not known."""
    at, found = _found(known, pair)
    return np.where(found, known[1][at], np.float16(0)).astype(np.float64) if len(known[0]) else np.zeros(len(pair))


def _probes(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a pair in the filter."""
    h = W.mix(pair.astype(U))
    return h >> U(64 - FILTER_BITS), W.mix(h + U(1)) >> U(64 - FILTER_BITS)


def _held(others: np.ndarray, pair: np.ndarray) -> np.ndarray:
    out = np.ones(len(pair), bool)
    for place in _probes(pair):
        out &= (others[place >> U(6)] >> (place & U(63))) & U(1) == 1
    return out


def discounts(seen: list[float]) -> list[float]:
    """Kneser-Ney discounts of counts of 1, 2, and 3 or more from how many things were counted 1, 2, 3 and 4 times; at least half of the count."""
    y = seen[0] / max(1.0, seen[0] + 2 * seen[1])
    return [min(float(k), max(0.5 * k, k - (k + 1) * y * seen[k] / max(1.0, seen[k - 1]))) for k in (1, 2, 3)]


def _left(counts: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    counts = counts.astype(np.float64)
    d = np.array([0.0, *discounts([float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)])])
    return counts - d[np.minimum(counts, 3).astype(np.int64)]


def word_level(follows: np.ndarray) -> np.ndarray:
    """P(word | class) of all buckets by ``follows``, continuation counts per class and bucket, over the shared level."""
    classes = (follows > 0).sum(axis=0).astype(np.float64)
    total = max(1.0, classes.sum())
    shared = np.maximum(classes - SHARED_DISCOUNT, 0) / total
    shared += (1 - shared.sum()) / follows.shape[1]
    left = [_left(own) for own in follows]
    back = max(1 - rest.sum() / max(1.0, own.sum(dtype=np.float64)) for rest, own in zip(left, follows))
    return np.stack([(1 - back) * rest / max(1e-9, rest.sum()) + back * shared for rest in left])


def pair_level(counts: DataFrame, words: np.ndarray) -> DataFrame:
    """``pair, n, gain``: what every pair with counts of its own adds, in UNITs, from ``counts (pair, n0, n1)`` and P(word | class); written once."""
    seen = counts.agg(*[F.count_if(F.col(f"n{c}") == k) for c in (0, 1) for k in (1, 2, 3, 4)]).first()
    left = {}
    for c in (0, 1):
        n, d = F.col(f"n{c}"), discounts([float(x) for x in seen[4 * c : 4 * c + 4]])
        left[f"k{c}"] = F.when(n >= 3, n - d[2]).when(n == 2, 2 - d[1]).otherwise(0.0)
    rows = counts.withColumns({"before": F.shiftright("pair", WORD_BITS), **left})
    sums = [F.sum(x).cast("double").alias(f"{x}_all") for x in ("n0", "n1", "k0", "k1")]
    contexts = rows.groupBy("before").agg(*sums).filter("k0_all > 0 and k1_all > 0")
    back = F.greatest(*[1 - F.col(f"k{c}_all") / F.col(f"n{c}_all") for c in (0, 1)])
    own = [((1 - F.col("back")) * F.col(f"k{c}") / F.col(f"k{c}_all")).alias(f"own{c}") for c in (0, 1)]
    known = rows.filter("k0 > 0 or k1 > 0").join(contexts.withColumn("back", back), "before").select("pair", (F.col("n0") + F.col("n1")).alias("n"), "back", *own)
    shared = counts.sparkSession.sparkContext.broadcast(words.astype(np.float32))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, back = batch.column("pair").to_numpy(), batch.column("back").to_numpy()
            below = shared.value[:, pair & (WORDS - 1)].astype(np.float64)
            full = [batch.column(f"own{c}").to_numpy() + back * below[c] for c in (0, 1)]
            gain = (np.log(full[1] / full[0]) - np.log(below[1] / below[0])).astype(np.float16)
            yield pa.record_batch([batch.column("pair"), batch.column("n"), pa.array((gain.astype(np.float64) * UNIT).astype(np.int64))], ["pair", "n", "gain"])

    found = materialize(known.mapInArrow(gains, "pair long, n long, gain long"), "gains")
    shared.destroy()
    return found


def _in_order(gains: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order and their gains as half floats; tasks pack them, so the driver gets a few hundred rows of bytes."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        pair, gain = table["pair"].to_numpy(), table["gain"].to_numpy() / UNIT
        order = np.argsort(pair)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "pairs": pa.array([pair[order].tobytes()], pa.binary()), "gains": pa.array([gain[order].astype(np.float16).tobytes()], pa.binary())})

    packed = gains.select("pair", "gain", F.shiftright("pair", 2 * WORD_BITS - 9).alias("chunk")).groupBy("chunk").applyInArrow(pack, "chunk long, pairs binary, gains binary")
    parts = sorted((tuple(r) for r in packed.toLocalIterator()), key=lambda r: r[0])
    return tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[i], kind) for r in parts)]) for i, kind in ((1, np.int64), (2, np.float16)))


def _filter(others: DataFrame) -> np.ndarray:
    """Filter over the pairs; Spark merges the bits, the driver gets a row per 64 of them at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_probes(batch.column("pair").to_numpy()))
            yield pa.record_batch([pa.array((places >> U(6)).astype(np.int64)), pa.array((U(1) << (places & U(63))).view(np.int64))], ["word", "bits"])

    merged = others.select("pair").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, U)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(U)
    return out


def tables_of(ratio: np.ndarray, gains: DataFrame, room: int) -> tuple[Tables, DataFrame | None]:
    """Tables with the most frequent pairs, ``room`` at most, and the rows of all others, if there are any. Pairs of about one frequency stay together."""
    kind = F.floor(4 * F.log2("n"))
    least = None
    for r in sorted(gains.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r.kind):
        room -= r["count"]
        if room < 0:
            break
        least = r.kind
    if room >= 0:
        return Tables(ratio, _in_order(gains)), None
    known = _in_order(gains.filter(kind >= least if least is not None else F.lit(False)))
    others = (gains.filter(kind < least) if least is not None else gains).select("pair", "gain")
    bounds = others.agg(F.min("gain"), F.max("gain")).first()
    return Tables(ratio, known, _filter(others), min(0, bounds[0]) / UNIT, max(0, bounds[1]) / UNIT), others


def fit(rows: DataFrame, room: int = PAIRS) -> Model:
    """Counts from ``rows (text, label, part)`` where part is 0, written once; calibration on the others. Tasks hold ``room`` pairs at most."""
    pairs = rows.filter("part = 0").select("text", "label").mapInArrow(pair_rows, "pair long, n0 long, n1 long")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    follows = dense(counts.mapInArrow(counted(2 * WORDS, _places), "place long, n double"), 2 * WORDS).reshape(2, WORDS)
    words = word_level(follows)
    tables, others = tables_of((np.log(words[1]) - np.log(words[0])).astype(np.float32), pair_level(counts, words), room)
    model = Model(rows.sparkSession.sparkContext.broadcast(tables), np.zeros(len(FEATURES) + 1), others=others)
    seen = scored(rows.filter("part <> 0"), model, ["label"])
    sample = seen.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(CALIBRATION_ROWS).select(*FEATURES, "label").toArrow()
    model.calibration = logistic(np.column_stack([sample[f].to_numpy() for f in FEATURES]), sample["label"].to_numpy())
    model.taught = bool(follows.any(axis=1).all()) and len(set(sample["label"].to_pylist())) == 2
    return model


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """doc_id, the kept columns, the features, score per row of ``docs`` (doc_id, text, ...)."""
    if model.others is not None:
        return _joined(docs, model, keep)
    shared, calibration = model.shared, model.calibration

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = shared.value.features(batch)
            score = probability(found, calibration)
            yield pa.record_batch(
                [batch.column("doc_id"), *(batch.column(c) for c in keep), *map(pa.array, found.T), pa.array(score)],
                ["doc_id", *keep, *FEATURES, "score"],
            )

    kept = "".join(f"{c} {dict(docs.dtypes)[c]}, " for c in keep) + "".join(f"{f} double, " for f in FEATURES)
    return docs.select("doc_id", "text", *keep).mapInArrow(apply, f"doc_id long, {kept}score double")


def _joined(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``scored`` where tasks do not hold all pairs: what is known of each text and its occurrences of other pairs are written once, the latter joined."""
    shared, calibration, kinds = model.shared, model.calibration, dict(docs.dtypes)
    kept = "".join(f"{c} {kinds[c]}, " for c in keep)
    known = f"row long, doc_id long, {kept}n long, mean double, worst double, total double, settled double, sums array<double>, begins array<long>, ends array<long>"

    def listed(values: np.ndarray, first: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            of, row = shared.value.opened(batch), batch.column("row")
            first = np.searchsorted(of.run_text, np.arange(batch.num_rows + 1))
            runs = [listed(x, first) for x in (of.run_sum, of.run_begin, of.run_end)]
            own = [row, batch.column("doc_id"), *(batch.column(c) for c in keep), *map(pa.array, (of.n.astype(np.int64), *of.words.T, of.total, of.settled)), *runs]
            names = ["row", "doc_id", *keep, "n", "mean", "worst", "total", "settled", "sums", "begins", "ends"]
            yield pa.record_batch([*own, pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())], [*names, "pair", "at"])
            for begin in range(0, len(of.pair), 1 << 16):
                part = slice(begin, begin + (1 << 16))
                size = len(of.pair[part])
                rest = [pa.nulls(size, x.type) for x in own[1:]]
                yield pa.record_batch([row.take(pa.array(of.pair_text[part])), *rest, pa.array(of.pair[part]), pa.array(of.pair_at[part], mask=~of.pair_needed[part])], [*names, "pair", "at"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, total, worst = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n", "total", "settled"))
            total = total + batch.column("more").fill_null(0).to_numpy(zero_copy_only=False) / UNIT
            for i, (sums, begins, ends, each) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sums", "begins", "ends", "each")))):
                gains = {e["at"]: e["gain"] / UNIT for e in each or ()}
                for run, begin, end in zip(sums, begins, ends):
                    worst[i] = max(worst[i], run + sum(gains.get(at, 0.0) for at in range(begin, end)))
            worst = np.where(n > RUN, worst, total) / RUN
            found = np.column_stack([batch.column("mean").to_numpy(), batch.column("worst").to_numpy(), total / np.maximum(n, 1), worst])
            yield pa.record_batch(
                [batch.column("doc_id"), *(batch.column(c) for c in keep), *map(pa.array, found.T), pa.array(probability(found, calibration))], ["doc_id", *keep, *FEATURES, "score"]
            )

    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *keep)
    found = materialize(texts.mapInArrow(look, f"{known}, pair long, at long"), "toxicity")
    far = found.filter("pair is not null").select("row", "pair", "at").join(model.others, "pair")
    far = far.groupBy("row").agg(F.sum("gain").alias("more"), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "gain"))).alias("each"))
    near = found.filter("pair is null").drop("pair", "at").join(far, "row", "left")
    return near.mapInArrow(finish, f"doc_id long, {kept}" + "".join(f"{f} double, " for f in FEATURES) + "score double")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, label: str = "toxic", room: int = PAIRS) -> Model:
    """Fit on labelled rows outside fold ``held_out``; the last of the other folds calibrates. Labels, language, source and id are no inputs of a score."""
    rows = labelled(docs, labels, label).withColumn("fold", fold(F.col("doc_id"), folds)).filter(F.col("fold") != held_out)
    last = max(f for f in range(folds) if f != held_out)
    return fit(rows.select("doc_id", "text", "label", (F.col("fold") == last).cast("int").alias("part")), room)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1), predicted (1 from 0.5 on), and the features by words and by pairs.

    Empty and null texts get the score of no evidence; long texts are read whole; repeated rows score alike; other columns are ignored.
    An empty table gives an empty one; without labelled rows of both classes every score is the classes' share, or 0.5 without any.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(plain, model, []).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` with a score below 0.5, all columns as they are. No text is moved where tasks hold all pairs: each row is judged where it is read.

    Otherwise toxic texts are known by 128 bits of hash, and rows with such a text go; up to MAX_LABELS of these hashes, counted first, are broadcast so that no text is
    moved either. All rows stay if the labelled rows of the counts or of the calibration are not of both classes: there is no evidence against any then.
    """
    if not model.taught:
        return docs
    if model.others is not None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        hashes = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
        judged = _joined(docs.select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(hashes))), model, ["h0", "h1"])
        toxic = materialize(judged.filter("score >= 0.5").select("h0", "h1").distinct(), "toxic")
        marks = F.broadcast(toxic) if toxic.count() <= MAX_LABELS else toxic
        return docs.join(marks, (hashes[0] == toxic["h0"]) & (hashes[1] == toxic["h1"]), "left_anti")
    shared, calibration = model.shared, model.calibration

    @F.arrow_udf("double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.record_batch([column], ["text"])
            parts = [probability(shared.value.features(part), calibration) for part in W.slices(iter([batch]), "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(judge(F.coalesce(F.col("text").cast("string"), F.lit(""))) < 0.5)
