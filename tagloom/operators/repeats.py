"""Repeat suppression as a composition of step functions.

What a run of times emits depends on one value only, the last emission before it, so a run is a function from that value to the last emission
after it. Functions of neighbouring runs compose, and composition is associative: runs of a bounded number of times are summarized in parallel, composed upwards in a
tree, and the tree is walked down again to hand every run its start. Neither rows nor summaries of a key ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tagloom.session import literal_rows, materialize

FAN = 8
_STEP = "key {k}, node long, n_rows long, first_ts long, upto array<long>, exit_ts array<long>, exit_row array<long>"
_ENTRY = "key {k}, node long, last_ts long, last_row long, rows_before long"


@dataclass
class Steps:
    """The function of a run: a walk whose next emission is due at ``x`` leaves a run at the first step with ``upto >= x``, at time ``exit_ts`` and row ``exit_row``; without such a step the run emits nothing."""

    n_rows: int
    first_ts: int
    upto: np.ndarray
    exit_ts: np.ndarray
    exit_row: np.ndarray

    def step(self, due: int | None) -> int:
        """Index of the step taken, ``len(upto)`` for none. Without an earlier emission the first row is emitted."""
        return 0 if due is None else int(np.searchsorted(self.upto, due, side="left"))


def _merged(steps: Steps) -> Steps:
    """Neighbouring steps that leave at the same row are one."""
    last = np.append(steps.exit_ts[1:] != steps.exit_ts[:-1], True) if len(steps.upto) else np.zeros(0, bool)
    return Steps(steps.n_rows, steps.first_ts, steps.upto[last], steps.exit_ts[last], steps.exit_row[last])


def steps_of(ts: np.ndarray, n: np.ndarray, window: int) -> Steps:
    """The function of distinct sorted times with ``n`` rows each."""
    before = np.concatenate(([0], np.cumsum(n)))
    jump = np.searchsorted(ts, ts + window, side="left")
    last = np.arange(len(ts))
    while (jump < len(ts)).any():  # doubling along the emissions
        inside = np.flatnonzero(jump < len(ts))
        last[inside] = last[jump[inside]]
        jump[inside] = jump[jump[inside]]
    # an emission before the run falls due before first + window
    entries = min(int(np.searchsorted(ts, ts[0] + window, side="left")) + 1, len(ts))
    exits = last[:entries]
    return _merged(Steps(int(before[-1]), int(ts[0]), ts[:entries], ts[exits], before[exits]))


def compose(first: Steps, then: Steps, window: int) -> Steps:
    """The function of two neighbouring runs. Only what an emission before ``first`` can reach is kept, one step for each distinct time within a window at most."""
    due = first.exit_ts + window
    at = np.searchsorted(then.upto, due, side="left")
    on = at < len(then.upto)
    safe = np.minimum(at, len(then.upto) - 1)
    exit_ts = np.where(on, then.exit_ts[safe], first.exit_ts)
    exit_row = np.where(on, first.n_rows + then.exit_row[safe], first.exit_row)
    low = np.concatenate(([first.upto[-1]], then.upto[:-1]))
    more = (then.upto > first.upto[-1]) & (low < first.first_ts + window)
    return _merged(Steps(
        first.n_rows + then.n_rows, first.first_ts, np.concatenate((first.upto, then.upto[more])),
        np.concatenate((exit_ts, then.exit_ts[more])), np.concatenate((exit_row, first.n_rows + then.exit_row[more])),
    ))


def _read(row) -> Steps:
    return Steps(int(row.n_rows), int(row.first_ts), *(np.asarray(x, np.int64) for x in (row.upto, row.exit_ts, row.exit_row)))


def _frame(key, node: int, s: Steps) -> pd.DataFrame:
    return pd.DataFrame({
        "key": [key], "node": [node], "n_rows": [s.n_rows], "first_ts": [s.first_ts], "upto": [s.upto], "exit_ts": [s.exit_ts], "exit_row": [s.exit_row],
    })


def _cut(size: int):
    """Number the runs of a sorted partition: a run ends with its key or after ``size`` times."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held, key = -1, size, None
        for batch in batches:
            changed = (batch["key"] != batch["key"].shift()) & ~(batch["key"].isna() & batch["key"].shift().isna())
            changed.iloc[0] = run < 0 or not (batch["key"].iloc[0] == key or (pd.isna(batch["key"].iloc[0]) and pd.isna(key)))
            begins = np.flatnonzero(changed.to_numpy())
            # rows since the run's key began, counting those of earlier batches
            place = np.arange(len(batch)) + (0 if changed.iloc[0] else held)
            for b in begins:
                place[b:] = np.arange(len(batch) - b)
            starts = place % size == 0
            batch["run"] = run + np.cumsum(starts)
            run, held, key = int(batch["run"].iloc[-1]), int(place[-1]) + 1, batch["key"].iloc[-1]
            yield batch

    return cut


def _summaries(window: int):
    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return _frame(pdf["key"].iloc[0], int(pdf["node"].iloc[0]), steps_of(pdf["ts"].to_numpy("int64"), pdf["n"].to_numpy("int64"), window))

    return summarize


def _upwards(window: int):
    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("node").itertuples())
        total = _read(rows[0])
        for row in rows[1:]:
            total = compose(total, _read(row), window)
        return _frame(rows[0].key, int(rows[0].node) // FAN, total)

    return up


def _downwards(window: int):
    """The start of each child from that of its parent."""

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pdf = [], pdf.sort_values("node")
        last, last_row, rows = (None if pd.isna(pdf["last_ts"].iloc[0]) else int(pdf["last_ts"].iloc[0])), int(pdf["last_row"].iloc[0]), int(pdf["rows_before"].iloc[0])
        for row in pdf.itertuples():
            out.append((row.key, row.node, last, last_row, rows))
            steps = _read(row)
            at = steps.step(None if last is None else last + window)
            if at < len(steps.upto):
                last, last_row = int(steps.exit_ts[at]), rows + int(steps.exit_row[at])
            rows += steps.n_rows
        return pd.DataFrame(out, columns=["key", "node", "last_ts", "last_row", "rows_before"]).astype({"last_ts": "Int64"})

    return down


def _walk(window: int):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        ts, seq = pdf["ts"].to_numpy("int64"), pdf["first"].to_numpy("int64")
        before = np.concatenate([[0], np.cumsum(pdf["n"].to_numpy("int64"))]) + int(pdf["rows_before"].iloc[0])
        leave = np.searchsorted(ts, ts + window, side="left")
        last, last_row = pdf["last_ts"].iloc[0], int(pdf["last_row"].iloc[0])
        at, path = 0 if pd.isna(last) else int(np.searchsorted(ts, int(last) + window, side="left")), []
        while at < len(ts):
            path.append(at)
            at = int(leave[at])
        rows = before[path]
        merged = np.diff(rows, prepend=last_row) - 1
        if len(path) and last_row < 0:
            merged[0] = 0
        return pd.DataFrame({"key": pdf["key"].iloc[0], "ts": ts[path], "seq": seq[path], "merged": merged})

    return walk


def runs_of(times: DataFrame, size: int) -> DataFrame:
    """``times(key, ts, ...)`` with ``node``: the runs of a key, numbered from 0 in the order of time, with ``size`` distinct times at most. Written once.

    A range sort by key and time deals a hot key out over many partitions; runs end at their borders.
    """
    placed = times.repartitionByRange("key", "ts").sortWithinPartitions("key", "ts").withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields) + ", run long"
    cut = materialize(placed.mapInPandas(_cut(size), schema), "runs")
    ends = sorted((r.part, r.runs) for r in cut.groupBy("part").agg((F.max("run") + 1).alias("runs")).collect())  # one row per partition
    offsets, total = [], 0
    for part, runs in ends:
        offsets.append((part, total))
        total += runs
    numbered = cut.join(F.broadcast(literal_rows(times.sparkSession, "part int, base long", offsets)), "part").withColumn("run", F.col("run") + F.col("base"))
    begin = numbered.groupBy("key").agg(F.min("run").alias("begin"))
    joined = numbered.alias("r").join(begin.alias("b"), F.col("r.key").eqNullSafe(F.col("b.key")))
    return joined.select("r.*", (F.col("run") - F.col("begin")).alias("node")).drop("part", "run", "base")


def suppress_repeats(events: DataFrame, window_us: int, run_rows: int = 16_384) -> DataFrame:
    """Per key: emit a row, swallow those within the window since the last *emitted* one, count them.

    ``events(key, ts, seq)`` with ``ts`` in microseconds; output ``key, ts, seq, merged``. Rows with equal key and time collapse before the first shuffle. No group holds more than ``run_rows``
    distinct times, and no summary more steps than a window has distinct times. A null key is a key; an empty table gives no rows.
    """
    times = events.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("seq").cast("long").alias("first"))
    runs = runs_of(times, run_rows)
    key_type = events.schema["key"].dataType.simpleString()
    step, entry = _STEP.format(k=key_type), _ENTRY.format(k=key_type)
    # the first run of a key needs no start from others
    first = runs.groupBy("key").agg(F.max("node").alias("last")).filter("last > 0")
    several = runs.alias("r").join(first.alias("f"), F.col("r.key").eqNullSafe(F.col("f.key"))).select("r.*")
    levels = [materialize(several.select("key", "node", "ts", "n").groupBy("key", "node").applyInPandas(_summaries(window_us), step), "steps")]
    width = levels[0].agg(F.max("node")).first()[0] or 0
    while width >= FAN:
        parent = F.floor(F.col("node") / FAN)
        levels.append(materialize(levels[-1].groupBy("key", parent.alias("parent")).applyInPandas(_upwards(window_us), step), "steps"))
        width //= FAN
    start = lambda rows: rows.withColumns({"last_ts": F.lit(None).cast("long"), "last_row": F.lit(-1).cast("long"), "rows_before": F.lit(0).cast("long")})
    starts = start(levels[-1].select("key").distinct().withColumn("node", F.lit(0).cast("long")))
    for level in reversed(levels):
        children = level.withColumn("parent", F.floor(F.col("node") / FAN)).alias("c")
        own = starts.withColumnRenamed("node", "parent").alias("p")
        both = children.join(own, F.col("c.key").eqNullSafe(F.col("p.key")) & (F.col("c.parent") == F.col("p.parent"))).select("c.*", "p.last_ts", "p.last_row", "p.rows_before")
        starts = both.groupBy("key", "parent").applyInPandas(_downwards(window_us), entry)
    known = runs.alias("r").join(starts.alias("s"), F.col("r.key").eqNullSafe(F.col("s.key")) & (F.col("r.node") == F.col("s.node")), "left")
    walked = known.select("r.*", "s.last_ts", F.coalesce("s.last_row", F.lit(-1)).alias("last_row"), F.coalesce("s.rows_before", F.lit(0)).alias("rows_before"))
    return walked.groupBy("key", "node").applyInPandas(_walk(window_us), f"key {key_type}, ts long, seq long, merged long")
