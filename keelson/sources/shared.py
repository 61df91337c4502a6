"""Folders that all executors see, for tables between jobs, checkpoints of streams and archives."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset and Spark is one process, below a temporary folder that goes at exit; on a cluster, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="keelson-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as written to a new path and read again: what comes after doesn't compute it anew, also if executors are lost."""
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is met by a shuffle whatever its size: files that are small as written, or rows that an explode makes of them, would else pass whole through the driver."""
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))
