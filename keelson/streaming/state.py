"""Stateful streams: a sampling grid, workers that fall silent, calls that complete and what is left of a stage.

Each processor keeps a few numbers a key in the state store, the grid those of a bucket of keys at once (columns that it reads must not begin with an underscore). Rows of a key that meet in one batch are put in time order; how a
stream is cut into batches, or restarted from its checkpoint, does not change what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ticks import Grid

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """While a stream is started: the state store that typed state and timers need. The stream keeps it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _packed(keys, *numbers: np.ndarray) -> bytes:
    """Keys and their numbers as an Arrow stream."""
    table, out = pa.table([pa.array(keys, from_pandas=True), *map(pa.array, numbers)], ["key", *map(str, range(len(numbers)))]), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> tuple[pd.Series, list[np.ndarray]]:
    table = pa.ipc.open_stream(bytes(held)).read_all()
    return table.column("key").to_pandas(), [c.to_numpy() for c in table.columns[1:]]


class GridSampler(StatefulProcessor):
    """Of each key the rows that answer targets of a grid: a row answers the earliest target still open if it is at or after that, and the next one open is the first after the row.

    Kept for each key: start, last tick, last target reached and rows seen. Keys are dealt into buckets, each with one state for all of its keys, so that a batch costs a
    call to the state store a bucket and not two or three a key. A missing tick, or one that doesn't rise, is an error: such a stream has no late rows.
    """

    def __init__(self, key: str, time: str, grid: Grid, start: str | None):
        self.key, self.time, self.grid, self.start = key, time, grid, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("grid", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        missing = got[self.time].isna()
        if missing.any():
            raise ValueError(f"{got[self.key][missing].iloc[0]}: a row without a tick")
        names, held = _unpacked(self.state.get()[0]) if self.state.exists() else (got[self.key].iloc[:0], np.zeros((4, 0), np.int64))
        code, keys = pd.factorize(pd.concat([names, got[self.key]], ignore_index=True) if len(names) else got[self.key], use_na_sentinel=False)
        of, old = code[len(names) :], len(names)
        order = np.lexsort((got[self.time].to_numpy(np.int64), of))
        tick, of = got[self.time].to_numpy(np.int64)[order], of[order]
        head = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero(head)
        end, own = np.append(first[1:], len(of)) - 1, of[first]
        start, last, reached, seen = (np.concatenate([x, np.full(len(keys) - old, new, np.int64)]) for x, new in zip(held, (0, 0, -1, 0), strict=True))
        new = own >= old
        start[own[new]] = got[self.start].to_numpy(np.int64)[order[first[new]]] if self.start else tick[first[new]]
        last[own[new]] = tick[first[new]] - 1
        before = np.concatenate([[0], tick[:-1]])
        before[first] = last[own]
        late = np.flatnonzero(tick <= before)
        if len(late):
            raise ValueError(f"{keys[of[late[0]]]}: tick {tick[late[0]]} doesn't follow the one before")
        after = np.maximum(self.grid.reached(tick, start[of]), reached[of])  # rises with the tick
        before = np.concatenate([[0], after[:-1]])
        before[first] = reached[own]
        row = seen[of] + np.arange(len(of)) - np.repeat(first, end - first + 1)
        last[own], reached[own] = tick[end], after[end]
        seen[own] += end - first + 1
        self.state.update((_packed(keys, start, last, reached, seen),))
        hit = after > before
        if hit.any():
            yield pd.DataFrame({self.key: got[self.key].to_numpy()[order[hit]], "target_index": before[hit] + 1, self.time: tick[hit], "row_index": row[hit]})


def grid_stream(frames: DataFrame, key: str, time: str, grid: Grid, start: str | None = None, buckets: int = 512) -> DataFrame:
    """key, target_index, time and row_index (of all rows of the key) of the rows of a stream that answer targets; start: a column with the first tick, or the key's first row counts.

    buckets: how many states the keys share; a stream's checkpoint holds for one number only.
    """
    kept = frames.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("key_bucket"), key, F.col(time).cast("long").alias(time), *([F.col(start).cast("long").alias(start)] if start else []))
    kind = kept.schema[key].dataType.simpleString()
    return kept.groupBy("key_bucket").transformWithStateInPandas(GridSampler(key, time, grid, start), f"{key} {kind}, target_index long, {time} long, row_index long", "append", "none")


class SilenceWatch(StatefulProcessor):
    """Of each worker, when it was lost (silent for longer than a limit) and when it came back. A timer finds the silence of workers that never come back."""

    def __init__(self, key: str, time: str, limit_us: int):
        self.key, self.time, self.limit = key, time, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last long, lost boolean")

    def _told(self, key, rows: list[tuple[str, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(rows), "state": [r[0] for r in rows], "at_us": [r[1] for r in rows], "last_us": [r[2] for r in rows]})

    def _due(self, last: int) -> int:
        return -(-(last + self.limit) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.sort(pd.concat(list(rows))[self.time].to_numpy(np.int64))
        last, lost = self.state.get() if self.state.exists() else (None, False)
        if last is not None and not lost:
            self.handle.deleteTimer(self._due(last))
        out = []
        for t in times.tolist():
            if last is not None and t - last > self.limit and not lost:
                out.append(("lost", last + self.limit, last))
                lost = True
            if lost:
                out.append(("back", t, last))
                lost = False
            last = t if last is None else max(t, last)
        self.state.update((last, lost))
        self.handle.registerTimer(self._due(last))
        if out:
            yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, lost = self.state.get()
        if not lost and self._due(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((last, True))
            yield self._told(key, [("lost", last + self.limit, last)])


def silence(events: DataFrame, key: str, time: str, limit_us: int, late: str = "1 hour") -> DataFrame:
    """key, state (lost or back), at_us and last_us (the last sign before) of a stream of signs of life; time is a timestamp. A loss is told once time, less late, has passed it."""
    kept = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).cast("timestamp").alias("seen_at"), F.unix_micros(F.col(time).cast("timestamp")).alias("seen_us")).withWatermark("seen_at", late)
    kind = kept.schema[key].dataType.simpleString()
    return kept.groupBy(key).transformWithStateInPandas(SilenceWatch(key, "seen_us", limit_us), f"{key} {kind}, state string, at_us long, last_us long", "append", "eventTime")


class Progress(StatefulProcessor):
    """Of each stage, after each completed task: how many are done, their mean time, and what is left."""

    def __init__(self, key: str, time: str, took: str, task: str, total: int, workers: int):
        self.key, self.time, self.took, self.task, self.total, self.workers = key, time, took, task, total, workers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("done", "n long, spent double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values([self.time, self.task])
        n, spent = self.state.get() if self.state.exists() else (0, 0.0)
        done = n + np.arange(1, len(got) + 1)
        total = spent + got[self.took].to_numpy(float).cumsum()
        mean = total / done
        self.state.update((int(done[-1]), float(total[-1])))
        left = np.maximum(self.total - done, 0)
        yield pd.DataFrame({self.key: key[0], self.task: got[self.task].to_numpy(), "done": done, "mean": mean, "eta": left * mean / self.workers})


def progress(completed: DataFrame, key: str, time: str, took: str, task: str, total: int, workers: int = 1) -> DataFrame:
    """key, task, done, mean and eta of a stream of completed tasks; rows without stage, time, task or duration tell nothing."""
    kept = completed.select(key, task, time, F.col(took).cast("double").alias(took)).dropna()
    kinds = {c: kept.schema[c].dataType.simpleString() for c in (key, task)}
    return kept.groupBy(key).transformWithStateInPandas(Progress(key, time, took, task, total, workers), f"{key} {kinds[key]}, {task} {kinds[task]}, done long, mean double, eta double", "append", "none")


def completions(started: DataFrame, completed: DataFrame, keys: list[str], within: str, late: str = "1 hour", how: str = "inner", carry: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """keys, started_at, completed_at and seconds of each start with each completion of its keys at most `within` later; two streams, or two tables.

    started: keys, started_at; completed: keys, completed_at; carry: other columns of either side that go along, no name twice. State of either side is dropped when the other's time has passed.
    With how="leftOuter", a start that nothing completed comes with nulls once its time is over.
    """
    mark = lambda df, c: df.withWatermark(c, late) if df.isStreaming else df
    a = mark(started.select(*keys, "started_at", *carry[0]), "started_at")
    b = mark(completed.select(*(F.col(k).alias(f"_{k}") for k in keys), "completed_at", *carry[1]), "completed_at")
    on = (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return a.join(b, on, how).select(*keys, "started_at", "completed_at", *carry[0], *carry[1], took.alias("seconds"))
