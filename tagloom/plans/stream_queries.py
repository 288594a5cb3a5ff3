"""Streams over the given tables run to the end, in several micro-batches; they must give the rows of their batch twins."""

from datetime import timedelta

from pyspark.sql import functions as F

from tagloom import streaming as R
from tagloom.plans import bindings as B
from tagloom.plans.image_queries import HOUR, SUPPRESS, _load_model, epoch_micros
from tagloom.plans.registry import ORACLES, query
from tagloom.session import shared_dir

FILES = 4


def in_turn(spark, parts, files=FILES):
    """A stream that has each part as a micro-batch of its own, in order. A part must have enough rows for so many files."""
    folder = shared_dir(spark, "stream-input")
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def thirds(table, order):
    """Three parts of a table by ranges of a column."""
    low, high = table.select(F.percentile_approx(order, [1 / 3, 2 / 3], F.lit(1000))).first()[0]
    return [table.filter(order < low), table.filter((order >= low) & (order < high)), table.filter(order >= high)]


@query("stream_suppress_repeats", SUPPRESS)
def suppress(spark, sf):
    """Rows without ``seq`` report what a state had swallowed when its window ended; all others are those of the batch twin."""
    e = B.table(spark, sf, "events").select(
        F.col("event_type").alias("key"), epoch_micros("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"),
    )
    out = shared_dir(spark, "stream-suppress")
    R.run_available(R.stream_suppress(in_turn(spark, thirds(e, F.col("ts"))), HOUR), out, shared_dir(spark, "checkpoint"))
    found = spark.read.schema("key string, ts long, seq long, merged long").parquet(out)
    return found.filter("seq is not null")


@query("stream_latest_results", ORACLES["results_latest"])
def latest(spark, sf):
    e = B.table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("version"), F.col("value").alias("result"), F.col("ts").cast("timestamp").alias("event_time")
    )
    out = shared_dir(spark, "stream-latest")
    ran = R.keep_newest(R.stream_latest(in_turn(spark, thirds(e, F.col("version"))), keep=timedelta(days=30), delay="400 days"), out, shared_dir(spark, "checkpoint"))
    ran.awaitTermination()
    return R.newest_table(spark, out, ran)


@query("stream_score", """
SELECT vec_id AS image_id, CASE WHEN vec_id % 3 = 0 THEN 'skipped' WHEN vec_id % 23 = 0 THEN 'failed' WHEN vec_id % 2 = 0 THEN 'skipped' ELSE 'succeeded' END AS outcome,
       CASE WHEN vec_id % 3 <> 0 AND vec_id % 23 = 0 THEN 'fp0' ELSE 'fp1' END AS fingerprint,
       CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 23 = 0 AND vec_id % 2 = 0 THEN 2 ELSE 1 END AS tries FROM embeddings""")
def score(spark, sf):
    """Even images come first and all of them after; a third is done already. What succeeded in the first micro-batch is not scored in the second, what failed is tried again."""
    from tagloom.operators import tensors as T

    done, table = F.col("vec_id") % 3 == 0, B.table(spark, sf, "embeddings")
    images = in_turn(spark, [table.filter("vec_id % 2 = 0"), table]).select(
        F.col("vec_id").alias("image_id"), F.when(done, "succeeded").otherwise("not_run").alias("state"), F.when(done, "fp1").otherwise("fp0").alias("fingerprint"),
        F.lit(None).cast("string").alias("last_error"), F.when(F.col("vec_id") % 23 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("tensor"),
    )
    known = table.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("image_id"), F.lit("fp1").alias("fingerprint"))
    out = shared_dir(spark, "stream-score")
    R.stream_score(images, known, lambda pending: T.score(pending, _load_model, 16, "fp1"), "fp1", out, shared_dir(spark, "checkpoint")).awaitTermination()
    tries = spark.read.parquet(out).groupBy("image_id").agg(F.count_if(F.col("outcome") != "skipped").cast("int").alias("tries"))
    return R.outcomes(spark, out).select("image_id", "outcome", "fingerprint").join(tries, "image_id")


@query("stream_import", "SELECT url AS path, CAST(CASE WHEN bool_or(page_id % 4 = 0) THEN 2 ELSE 1 END AS BIGINT) AS n FROM pages GROUP BY url")
def imported(spark, sf):
    """All page addresses, then markers that forget a quarter of them, then all again: a forgotten address comes out a second time."""
    pages = B.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    turn = lambda rows, at, forget: rows.select("path", F.timestamp_seconds(F.lit(1_000_000 + at)).alias("time"), F.lit(forget).alias("forget"))
    s = in_turn(spark, [turn(pages, 0, False), turn(pages.filter("page_id % 4 = 0"), 1, True), turn(pages, 2, False)])
    rows = lambda which: s.filter(which).select("path", "time")
    out = shared_dir(spark, "stream-import")
    R.run_available(R.known_paths(rows("NOT forget"), rows("forget"), keep=timedelta(days=30)), out, shared_dir(spark, "checkpoint"))
    return spark.read.schema("path string").parquet(out).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
