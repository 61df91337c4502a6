"""Tables written to the shared folder, to cut lineage so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset and Spark runs in one process (tests), a temporary one, removed at exit; on a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="keelson-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        found = _local[0]
    return found.rstrip("/")


class Scratch:
    """A folder of its own below the shared one, for the tables of one run of an operator.

    What an operator returns still reads from it; callers that have written that can close() it, or leave a with block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/keelson-{uuid.uuid4().hex}", 0

    def new(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table", plain: bool = False) -> DataFrame:
        """df as written and read again. plain: without dictionaries of values, which cost time where hashes and places hardly repeat."""
        schema, path = df.schema, self.new(name)
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._keelson_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for t in tables:
            self._delete(t._keelson_path)

    def close(self) -> None:
        """Delete the folder."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alone(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; what else a table has, whatever its name, goes no further."""
    return df.select(*(df[c] for c in columns))
