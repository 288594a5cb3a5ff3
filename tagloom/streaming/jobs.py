"""Structured Streaming jobs: importing, scoring, suppressing repeats, keeping the newest result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tagloom.operators.images import run_batch
from tagloom.sources.images import has_image_extension
from tagloom.streaming.keyed import Suppressor, equal_times_as_one, known_step, newest_step, use_keyed_state

__all__ = [
    "stream_import", "first_listing", "known_paths", "stream_score", "outcomes", "stream_suppress", "stream_latest", "keep_newest", "newest_table", "run_available",
]


def stream_import(
    spark: SparkSession, directory: str, forget_after: str | None = None, files_per_trigger: int = 1000, forget: DataFrame | None = None, keep: timedelta | None = None
) -> DataFrame:
    """Image files as they appear, every path once. Twin: ``dedupe_paths``.

    Without ``forget`` whole rows come out: known paths are kept for good, or bounded by ``forget_after``. With a stream ``forget(path, time)`` of paths to be forgotten,
    ``path, time`` (of listing) come out, see ``known_paths``; contents are then read by whoever needs them, not carried through the state step.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(directory)
    ).filter(has_image_extension(F.col("path")))
    if forget is None:
        return first_listing(files, forget_after)
    return known_paths(files.select("path", F.current_timestamp().alias("time")), forget, keep)


def first_listing(listing: DataFrame, forget_after: str | None = None, time: str = "modificationTime") -> DataFrame:
    """First row per path of a stream of listed files."""
    if forget_after is None:
        return listing.dropDuplicates(["path"])
    return listing.withWatermark(time, forget_after).dropDuplicatesWithinWatermark(["path"])


def known_paths(listing: DataFrame, forget: DataFrame, keep: timedelta | None = None, delay: str = "1 hour") -> DataFrame:
    """``path, time`` of listed paths that are not known: never listed, or forgotten since.

    Both streams are ``path, time``, where ``time`` tells when a path was listed or forgotten. A marker removes the path's state; one at the time of a listing counts as later. With ``keep`` a state
    also goes when ``time`` has passed the path's last row by so much, which bounds the state (rows more than ``delay`` behind are late then); without, paths are known until they are forgotten.
    """
    both = listing.select("path", "time", F.lit(False).alias("forget")).unionByName(forget.select("path", "time", F.lit(True).alias("forget")))
    keep_ms = None if keep is None else int(keep.total_seconds() * 1000)
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    both = both if keep is None else both.withWatermark("time", delay)
    return both.groupBy("path").applyInPandasWithState(known_step(keep_ms), "path string, time timestamp", "seen_ms long", "append", timeout)


def outcomes(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The newest outcome per image of a folder of batches, None while there is none. ``before`` reads earlier batches only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(out)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    others = [c for c in rows.columns if c not in ("image_id", "batch")]
    return rows.groupBy("image_id").agg(F.max_by(F.struct(*others), "batch").alias("o")).select("image_id", "o.*")


def stream_score(
    images: DataFrame, predictions: DataFrame, score: Callable[[DataFrame], DataFrame], fingerprint: str, out: str, checkpoint: str
) -> StreamingQuery:
    """``run_batch`` on each micro-batch of a stream of images; every outcome is a row of the folder ``out``.

    A micro-batch reads what earlier ones wrote: an image that has an outcome there continues with its state, fingerprint and error, and counts as predicted
    if it succeeded, so it is not scored twice. Of an image repeated within a micro-batch one row counts. The batch id names the folder of a
    micro-batch, so one repeated after a failure overwrites itself and never reads its own rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["image_id"])
        earlier, known = outcomes(spark, out, batch_id) if batch_id else None, predictions.select("image_id", "fingerprint")
        if earlier is not None:
            own = earlier.join(batch.select("image_id"), "image_id", "left_semi")
            own = own.select("image_id", F.struct("state", "fingerprint", "last_error").alias("o"))
            known = known.unionByName(own.filter("o.state = 'succeeded'").select("image_id", "o.fingerprint"))
            newest = {c: F.when(F.col("o").isNull(), F.col(c)).otherwise(F.col(f"o.{c}")) for c in ("state", "fingerprint", "last_error")}
            batch = batch.join(own, "image_id", "left").withColumns(newest).select(*batch.columns)
        run_batch(batch, known, score, fingerprint).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_suppress(events: DataFrame, window_us: int, delay: str = "1 hour") -> DataFrame:
    """Suppress repeats per key on a stream ``key, ts, seq, event_time``. Twin: ``suppress_repeats``.

    Output ``key, ts, seq, merged``. Rows of equal key and time are collapsed before the state step, which holds three numbers for each other time of a key in one micro-batch
    (bounded by the trigger). Rows more than ``delay`` behind are late. When event time has passed the window of a key's last emission, its state is dropped, and
    if it had swallowed rows they are reported as ``(key, time of the emission, null, number)``; the key's next emission then starts from 0.
    """
    use_keyed_state(events)
    key_type = events.schema["key"].dataType.simpleString()
    collapsed = equal_times_as_one(events).withWatermark("event_time", delay)
    return collapsed.groupBy("key").transformWithStateInPandas(Suppressor(window_us, key_type), f"key {key_type}, ts long, seq long, merged long", "append", "EventTime")


def stream_latest(results: DataFrame, keep: timedelta = timedelta(days=1), delay: str = "1 hour") -> DataFrame:
    """Results that are newer than all before of their image: a stream ``image_id, version, result`` from ``image_id, version, result, event_time``. Twin: ``latest_results``.

    The state of an image is one version number and goes ``keep`` of event time after its last row. Rows more than ``delay`` behind are late and dropped, so none older than the state comes
    after it has gone. ``keep_newest`` holds the result per image.
    """
    kind = results.schema["result"].dataType.simpleString()
    image = results.schema["image_id"].dataType.simpleString()
    rows = results.select("image_id", F.col("version").cast("long").alias("version"), "result", "event_time").withWatermark("event_time", delay)
    step = newest_step(int(keep.total_seconds() * 1000))
    return rows.groupBy("image_id").applyInPandasWithState(
        step, f"image_id {image}, version long, result {kind}", "version long, seen_ms long", "update", GroupStateTimeout.EventTimeTimeout
    )


def keep_newest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A table of one row per image below ``out``, a folder per micro-batch; the last folder is the table (``newest_table``).

    A micro-batch joins its rows to the table before it, and a stored version yields only to a greater one; repeated after a failure it overwrites itself. Folders before the last two may be removed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            old = spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id - 1}")
            news = batch.select("image_id", F.struct("version", "result").alias("n"))
            both = old.select("image_id", F.struct("version", "result").alias("o")).join(news, "image_id", "full")
            won = F.when(F.col("o").isNull() | (F.col("n.version") > F.col("o.version")), F.col("n")).otherwise(F.col("o"))
            batch = both.select("image_id", won.alias("w")).select("image_id", "w.version", "w.result")
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def newest_table(spark: SparkSession, out: str, query: StreamingQuery) -> DataFrame:
    """The table after the last micro-batch of a query that has ended."""
    last = max(p["batchId"] for p in query.recentProgress)
    return spark.read.parquet(f"{out}/batch={last}")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into parquet below ``out`` and stop.

    Changed rows (update mode) go to one folder per batch; a repeated batch overwrites its own.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    query.awaitTermination()
