"""State per key with timers: suppression of repeats, newest results, known paths that can be forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

#: The state store that keeps each state of a key by itself and has timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(frame: DataFrame) -> None:
    """Streams of this session started from now on keep state in the store that timers need."""
    frame.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _rearm(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    handle.registerTimer(at_ms)


class Suppressor(StatefulProcessor):
    """Emits a row per key and window and counts the others. The state is the last emission and how many rows it has swallowed since.

    A timer at the end of the window removes the state; what it had swallowed is then reported as a row without ``seq``.
    """

    def __init__(self, window_us: int, key_type: str) -> None:
        self.window, self.key_type = window_us, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ts long, swallowed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["ts"].to_numpy("int64"), p["first"].to_numpy("int64"), p["n"].to_numpy("int64")) for p in rows]
        ts, seq, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((seq, ts))
        ts, seq, n = ts[order], seq[order], n[order]
        before = np.concatenate(([0], np.cumsum(n)))
        last, swallowed = self.state.get() if self.state.exists() else (None, 0)
        at, path = 0 if last is None else int(np.searchsorted(ts, last + self.window, side="left")), []
        while at < len(ts):
            path.append(at)
            at = int(np.searchsorted(ts, ts[at] + self.window, side="left"))
        merged = []
        for place in path:
            merged.append(swallowed + int(before[place]) - (int(before[path[len(merged) - 1]]) + 1 if merged else 0))
            swallowed, last = 0, int(ts[place])
        swallowed += int(before[-1]) - (int(before[path[-1]]) + 1 if path else 0)
        self.state.update((last, swallowed))
        _rearm(self.handle, max((last + self.window) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(path), dtype=object), "ts": ts[path], "seq": pd.array(seq[path], dtype="Int64"), "merged": np.array(merged, np.int64)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, swallowed = self.state.get()
        self.state.clear()
        rows = [(key[0], last, None, swallowed)] if swallowed else []
        yield pd.DataFrame(rows, columns=["key", "ts", "seq", "merged"]).astype({"ts": "int64", "seq": "Int64", "merged": "int64"})

    def close(self) -> None:
        pass


def equal_times_as_one(events: DataFrame) -> DataFrame:
    """``key, ts, seq, event_time`` with rows of equal key and time collapsed within each batch of a partition: ``first`` seq and number ``n``.

    Repeats mostly come together, so that a hot key reaches its state step as few rows.
    """

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby(["key", "ts"], dropna=False, as_index=False, sort=False)
            yield grouped.agg(first=("seq", "min"), n=("seq", "size"), event_time=("event_time", "max"))

    key_type = events.schema["key"].dataType.simpleString()
    return events.select("key", "ts", "seq", "event_time").mapInPandas(collapse, f"key {key_type}, ts long, first long, n long, event_time timestamp")


def newest_step(keep_ms: int):
    """Emits a result whenever it is newer than the state's version. The state of a key goes when event time has passed its last row by ``keep_ms``.

    States of many keys travel with their rows in Arrow batches, which a step with few bytes of state and many keys needs more than single calls.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, seen = state.get if state.exists else (None, 0)
        best = None
        for part in parts:
            seen = max(seen, int(part["event_time"].max().timestamp() * 1000))
            at = part["version"].idxmax()
            if version is None or part["version"][at] > version:
                version, best = int(part["version"][at]), part.loc[[at], ["version", "result"]]
        state.update((version, seen))
        state.setTimeoutTimestamp(max(seen + keep_ms, state.getCurrentWatermarkMs() + 1))
        if best is not None:
            best.insert(0, "image_id", key[0])
            yield best

    return step


def known_step(keep_ms: int | None):
    """Lets a path through once, until it is forgotten: by a marker row, or by ``keep_ms`` of event time without a row of it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, out = state.get[0] if state.exists else None, []
        rows = pd.concat([p[["time", "forget"]] for p in parts]).sort_values(["time", "forget"])
        for time, forget in zip(rows["time"], rows["forget"]):
            at = int(time.timestamp() * 1000)
            if not forget and (seen is None or (keep_ms is not None and at - seen > keep_ms)):
                out.append((key[0], time))
            seen = None if forget else at
        if seen is not None:
            state.update((seen,))
            if keep_ms is not None:
                state.setTimeoutTimestamp(max(seen + keep_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "time"]).astype({"time": "datetime64[us]"})

    return step
