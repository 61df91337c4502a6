"""A write-ahead journal of calls that must not be made twice.

A stream's batches go to `settle`. Calls of a batch are first committed as started, then made, then committed as settled; both tables lie below the batch's
number. A batch that dies in between is run again by Spark with the same number: its started calls may have been made, so they are settled as uncertain and never made
again. Within a batch, a task that Spark runs again finds itself a later attempt, and says uncertain for its calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import exists

FLUSH = 16


def in_flushes(call: Callable[[pd.DataFrame], list[str]], size: int = FLUSH) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives call `size` rows of a partition at a time, and what is left at its end. Adds flush, status, answer and error.

    A flush that raises has failed: its calls are settled as uncertain, as some may have been made, and the rest goes on.
    """

    def told(rows: pd.DataFrame, flush: int, status: str, answer: list[str | None], error: str | None) -> pd.DataFrame:
        return rows.assign(flush=flush, status=status, answer=answer, error=error)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a job of one stage without a shuffle: what is run again is a later attempt of the task
        again = TaskContext.get() is not None and TaskContext.get().attemptNumber() > 0
        held, n = None, 0

        def made(rows: pd.DataFrame) -> pd.DataFrame:
            none = [None] * len(rows)
            if again:
                return told(rows, n, "uncertain", none, "the task was run before")
            try:
                answer = call(rows)
            except Exception as e:  # what the call raises is its outcome
                return told(rows, n, "uncertain", none, f"{type(e).__name__}: {e}")
            if len(answer) != len(rows):
                raise ValueError("a call answers each of its rows")
            return told(rows, n, "completed", answer, None)

        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while len(held) >= size:
                yield made(held.iloc[:size].reset_index(drop=True))
                held, n = held.iloc[size:], n + 1
        if held is not None and len(held):
            yield made(held.reset_index(drop=True))

    return run


class Journal:
    """Calls by keys below a shared path, under one protocol: a fingerprint of what makes answers what they are. Calls made under another one are an error."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], protocol: str):
        self.spark, self.path, self.keys, self.protocol = spark, path.rstrip("/"), list(keys), protocol

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _committed(self, kind: str, batch: int) -> bool:
        return exists(self.spark, f"{self._at(kind, batch)}/_SUCCESS")

    def settled(self) -> DataFrame | None:
        """All settled calls, or None where there are none yet."""
        return self.spark.read.option("basePath", f"{self.path}/settled").parquet(f"{self.path}/settled") if exists(self.spark, f"{self.path}/settled") else None

    def settle(self, call: Callable[[pd.DataFrame], list[str]], time: str, size: int = FLUSH) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch. Of calls that share keys the earliest is made, if none of an earlier batch was; rows without a key are left out."""

        def run(rows: DataFrame, batch: int) -> None:
            if self._committed("settled", batch):
                return  # the sink was done when the stream stopped
            columns = rows.columns
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            out = f"{kinds}, flush int, status string, answer string, error string"
            if self._committed("started", batch):
                before = self.spark.read.parquet(self._at("started", batch))
                done = before.select(*columns, F.lit(-1).alias("flush"), F.lit("uncertain").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit("the batch was run before").alias("error"))
            else:
                place = Window.partitionBy(*self.keys).orderBy(time, *(c for c in columns if c not in self.keys and c != time))
                new = rows.dropna(subset=self.keys).withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
                old = self.settled()
                if old is not None:
                    other = old.where(F.col("protocol") != self.protocol).limit(1)
                    if not other.isEmpty():
                        raise ValueError("the journal was written under another protocol")
                    new = new.join(old.select(*self.keys), self.keys, "left_anti")
                new.select(*columns).write.mode("overwrite").parquet(self._at("started", batch))
                done = self.spark.read.schema(rows.schema).parquet(self._at("started", batch)).mapInPandas(in_flushes(call, size), out)
            done.withColumn("protocol", F.lit(self.protocol)).write.mode("overwrite").parquet(self._at("settled", batch))

        return run


def actions(calls: DataFrame, settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """calls with action: completed ones are reused (with their answer), uncertain ones blocked, others free."""
    of = settled.groupBy(*keys).agg(F.max_by("status", F.col("status") == "uncertain").alias("_status"), F.max("answer").alias("answer"))
    out = calls.join(of, list(keys), "left")
    return out.withColumn("action", F.when(F.col("_status").isNull(), "free").when(F.col("_status") == "completed", "reuse").otherwise("blocked")).drop("_status")
