"""Streams whose state is carried over, expires and can be forgotten; every part is a micro-batch of its own."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tagloom import streaming as R
from tagloom.plans.stream_queries import in_turn

START = 1_000_000


def _time(seconds):
    return F.timestamp_seconds(F.lit(START) + F.col(seconds))


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_idle_key_loses_its_state_and_reports_what_it_swallowed(spark, tmp_path):
    second = 1_000_000
    parts = [
        [("a", 0), ("b", 1), ("b", 2), ("b", 2), ("a", 3)],
        [("a", 100), ("a", 103), ("a", 103), ("a", 109)],
        [("a", 150)],
        [("a", 160)],
        [("b", 200), ("a", 200), ("b", 204)],
    ]
    seq, frames = 0, []
    for part in parts:
        rows = [(k, (START + t) * second, seq + i, t) for i, (k, t) in enumerate(part)]
        seq += len(part)
        frames.append(spark.createDataFrame(rows, "key string, ts long, seq long, s long").select("key", "ts", "seq", _time("s").alias("event_time")))
    stream = R.stream_suppress(in_turn(spark, frames, 1), 10 * second, "1 second")
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "o")).start()
    query.awaitTermination()
    got = {(r.key, r.ts // second - START, r.merged, r.seq is None) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    emitted = {x for x in got if not x[3]}
    assert {x[:2] for x in emitted} == {("a", 0), ("b", 1), ("a", 100), ("a", 150), ("a", 160), ("b", 200), ("a", 200)}
    # every swallowed row is reported once, by the next emission or when the window has ended
    assert ("b", 1, 2, True) in got and ("b", 200, 0, False) in got
    assert sum(x[2] for x in got if x[0] == "a") == 4
    keys = [r for r in _state_rows(query)]
    assert min(keys[2:4]) < keys[0], keys  # b was gone while it was idle


def _latest(spark, parts):
    make = lambda rows: spark.createDataFrame(rows, "image_id string, version long, result double, s long")
    return in_turn(spark, [make(p).select("image_id", "version", "result", _time("s").alias("event_time")) for p in parts], 1)


def test_newest_result_survives_late_rows_and_expiry(spark, tmp_path):
    parts = [
        [("a", 1, 0.1, 0), ("b", 5, 0.5, 0), ("a", 2, 0.2, 1)],
        [("c", 1, 9.0, 1000), ("a", 1, 7.0, 990)],
        [("a", 3, 0.3, 1001)],
        [("b", 4, 0.4, 1)],  # comes after its state has gone
        [("c", 0, 8.0, 1002)],
    ]
    query = R.keep_newest(R.stream_latest(_latest(spark, parts), keep=timedelta(seconds=60), delay="30 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    table = R.newest_table(spark, str(tmp_path / "o"), query)
    assert sorted(tuple(r) for r in table.collect()) == [("a", 3, 0.3), ("b", 5, 0.5), ("c", 1, 9.0)]
    assert _state_rows(query)[-1] <= 2
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) == 1


@pytest.mark.parametrize("keep,again", [(None, {"b": 2, "a": 1, "late": 1}), (timedelta(seconds=60), {"b": 2, "a": 2, "late": 1})])
def test_forgotten_and_expired_paths_come_again(spark, tmp_path, keep, again):
    rows = [
        [("a", 0, False), ("b", 0, False), ("b", 0, False)],
        [("b", 1, True), ("nobody", 1, True)],
        [("late", 500, False), ("b", 500, False)],
        [("a", 510, False), ("b", 510, False)],
    ]
    stream = in_turn(spark, [spark.createDataFrame(r, "path string, s long, forget boolean").select("path", _time("s").alias("time"), "forget") for r in rows], 1)
    pick = lambda which: stream.filter(which).select("path", "time")
    R.run_available(R.known_paths(pick("NOT forget"), pick("forget"), keep, "1 second"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.path: r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("path").count().collect()}
    assert got == again


def test_image_sent_twice_is_scored_once(spark, tmp_path):
    make = lambda ids: spark.createDataFrame([(i, "not_run", None, None) for i in ids], "image_id string, state string, fingerprint string, last_error string")
    images = in_turn(spark, [make("ab"), make("bbcx"), make("abcx")], 1)
    none = spark.createDataFrame([], "image_id string, fingerprint string")

    def score(pending):
        bad = F.col("image_id") == "x"
        return pending.select("image_id", F.when(bad, "failed").otherwise("succeeded").alias("state"), F.when(bad, "no").alias("error"), F.array(F.lit(1.0).cast("float")).alias("probabilities"))

    R.stream_score(images, none, score, "fp", str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    every = spark.read.parquet(str(tmp_path / "o"))
    tries = {r.image_id: r.n for r in every.groupBy("image_id").agg(F.count_if(F.col("outcome") != "skipped").alias("n")).collect()}
    assert tries == {"a": 1, "b": 1, "c": 1, "x": 2}
    assert {r.image_id: (r.state, r.last_error) for r in R.outcomes(spark, str(tmp_path / "o")).collect()} == {i: ("succeeded", None) for i in "abc"} | {"x": ("failed", "no")}
