"""Tables as streams: landed in files in time order, run until all is read, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch_path
from .state import state_store


def land(df: DataFrame, time: str, path: str, cuts: int = 4) -> None:
    """Write a table in so many steps of its time, as a producer would: one file each, the earlier first."""
    at = F.unix_micros(F.col(time).cast("timestamp")) if df.schema[time].dataType.simpleString().startswith(("timestamp", "date")) else F.col(time)
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        df.limit(0).write.mode("append").parquet(path)
        return
    edges = [low + (high - low) * k // cuts for k in range(1, cuts)]
    for a, b in zip([None, *edges], [*edges, None], strict=True):
        part = df.where((F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b))
        part.coalesce(1).write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_now(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, append to the files of path, and return what they hold. A second run goes on from the checkpoint."""
    spark = stream.sparkSession
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def streamed(df: DataFrame, time: str, job, cuts: int = 4) -> DataFrame:
    """What job makes of a table as a stream of so many batches."""
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "stream")
    land(df, time, f"{root}/in", cuts)
    return run_now(job(follow(spark, f"{root}/in", df.schema)), f"{root}/out", f"{root}/checkpoint")
