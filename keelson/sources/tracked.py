"""Inputs that must not change while they are used: digests of each partition of a table, kept as a manifest and compared again.

A digest doesn't depend on the order of rows: a row's SHA-256 counts as eight numbers of 32 bits, which are added up, so partitions are digested where they lie and only sums are moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists

MANIFEST = "table string, partition string, rows long, digest string"


def row_text(columns: Mapping[str, str]) -> Column:
    """A row as one text that no other row has: for each column, by name, its length and value, or - for null."""
    def part(name: str, kind: str) -> Column:
        plain = kind in ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date") or kind.startswith(("decimal", "char", "varchar"))
        value = F.col(f"`{name}`").cast("string") if plain else F.hex(F.col(f"`{name}`")) if kind == "binary" else F.to_json(F.struct(F.col(f"`{name}`")), {"ignoreNullFields": "false"})
        return F.when(F.col(f"`{name}`").isNull(), "-").otherwise(F.concat(F.char_length(value).cast("string"), F.lit(":"), value))

    return F.concat_ws("", *(part(n, columns[n]) for n in sorted(columns)))


def digests(df: DataFrame, name: str, partition: Column | None = None) -> DataFrame:
    """table, partition, rows and digest of each partition: by the given column, or else by the file that rows come from."""
    kinds = dict(df.dtypes)
    part = F.input_file_name() if partition is None else F.coalesce(partition.cast("string"), F.lit(""))
    d = df.select(part.alias("partition"), F.sha2(row_text(kinds), 256).alias("_d"))
    add = lambda i: F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    sums = d.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), *(add(i).alias(f"_s{i}") for i in range(8)))
    return sums.select(F.lit(name).alias("table"), "partition", "rows", F.sha2(F.concat_ws("-", *(f"_s{i}" for i in range(8))), 256).alias("digest"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """table, partition and how it differs between two manifests: changed (rows differ, or the digest alone), missing or unexpected."""
    key = ["table", "partition"]
    both = before.select(*key, F.struct("rows", "digest").alias("_b")).join(after.select(*key, F.struct("rows", "digest").alias("_a")), key, "full")
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").when(F.col("_a.rows") != F.col("_b.rows"), "rows_changed").when(F.col("_a.digest") != F.col("_b.digest"), "content_changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "kind", F.col("_b.rows").alias("rows_before"), F.col("_a.rows").alias("rows_after"))


class Inputs:
    """Tables of one run, frozen at a shared path. A run that goes on finds its manifest there, and refuses to go on with other inputs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {}

    def add(self, name: str, read, partition: Column | None = None) -> DataFrame:
        """The table that read() gives; read is called again when inputs are compared."""
        if name in self.tables:
            raise ValueError(f"two inputs named {name}")
        self.tables[name] = (read, partition)
        return read()

    def now(self) -> DataFrame:
        out = self.spark.createDataFrame([], MANIFEST)
        for name, (read, partition) in sorted(self.tables.items()):
            out = out.unionByName(digests(read(), name, partition))
        return out

    def freeze(self) -> None:
        """Write the manifest; where one is, it must be the same."""
        if exists(self.spark, f"{self.path}/_SUCCESS"):
            self.verify()
        else:
            self.now().coalesce(1).write.mode("overwrite").parquet(self.path)

    def verify(self) -> None:
        """An error that names what has changed since the manifest was written."""
        found = drift(self.spark.read.schema(MANIFEST).parquet(self.path), self.now())
        told: Sequence = found.orderBy("table", "partition").limit(20).collect()
        if told:
            raise ValueError("inputs changed: " + ", ".join(f"{r['table']}/{r['partition']} ({r['kind']})" for r in told))
