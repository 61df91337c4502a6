"""Streams: event-time windows, an order check and an append-only ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_at_once: int = 8, glob: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder, by the schema of those there now."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).parquet(path)


def window_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """n and total by tumbling window and kind; what is later than the watermark is not counted."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    return stream.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def session_counts(events: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    stream = events.withWatermark(time, late) if events.isStreaming else events
    return stream.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def ordered_only(events: DataFrame, key: str, tick: str) -> DataFrame:
    """key, n, last of each key and batch; a tick that doesn't rise is an error, since a frame stream has no late data."""

    def check(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -(2**63))
        got = pd.concat(list(parts))[tick].sort_index()
        for t in got:
            if t <= last:
                raise ValueError(f"{k[0]}: tick {t} after {last}")
            n, last = n + 1, int(t)
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(check, f"{key} {kind}, n long, last long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def ledger(calls: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first call of each key; later ones within the watermark are dropped."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if calls.isStreaming else calls.dropDuplicates(keys)


def call_states(calls: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Of each key, what may be done: completed calls are reused, uncertain ones blocked, others free."""
    has = lambda x: F.bool_or(F.col(status) == x)
    return calls.groupBy(*keys).agg(F.when(has("completed"), "reuse").when(has("running_may_generate"), "blocked").otherwise("free").alias("action"))
