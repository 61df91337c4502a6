"""Sources and sinks: JSON, CSV, Parquet, NPY and framed payloads; write-once tables and digests."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    """Documents of a given schema; a document that doesn't parse fails the read."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows under a header, by the given types only."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """path, row, vec of matrices in .npy files, without pickled objects."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(x), 4096):
                    yield pd.DataFrame({"path": p, "row": np.arange(at, min(at + 4096, len(x))), "vec": [v.astype(np.float32) for v in x[at : at + 4096]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(rows, "path string, row long, vec array<float>")


def read_npz(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """path, name, shape, values of the arrays in .npz files, without pickled objects; an array must fit a task."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for name in held.files:
                        x = held[name]
                        yield pd.DataFrame({"path": [p], "name": [name], "shape": [list(x.shape)], "values": [x.astype(np.float64).ravel()]})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(rows, "path string, name string, shape array<long>, values array<double>")


def frame_payload(header: dict, blobs: Sequence[bytes]) -> bytes:
    """Length of the header (8 bytes), the header as JSON with sizes, then the blobs."""
    head = json.dumps(header | {"sizes": [len(b) for b in blobs]}, sort_keys=True, allow_nan=False).encode()
    return struct.pack("!Q", len(head)) + head + b"".join(blobs)


def unframe_payload(raw: bytes) -> tuple[dict, list[bytes]]:
    """The header and blobs of a payload, which must end where the header says."""
    if len(raw) < 8 or len(raw) < 8 + (n := struct.unpack("!Q", raw[:8])[0]):
        raise ValueError("payload ends early")
    header = json.loads(raw[8 : 8 + n])
    at, blobs = 8 + n, []
    for size in header["sizes"]:
        blobs.append(raw[at : at + size])
        at += size
    if at != len(raw):
        raise ValueError("payload is of another length than its header says")
    return header, blobs


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of the columns as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and a digest that doesn't depend on their order: sums of the parts of row digests."""
    d = row_digest(df.columns)
    part = lambda i: F.sum(F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("-", *(F.coalesce(part(i), F.lit("0")) for i in range(8))), 256).alias("digest"))


def write_once(df: DataFrame, path: str) -> bool:
    """Write df where nothing is; where something is, it must hold the same rows. Whether it was written."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(old.columns) != sorted(df.columns) or not (old.select(*df.columns).exceptAll(df).isEmpty() and df.exceptAll(old.select(*df.columns)).isEmpty()):
        raise ValueError("the table exists with other rows")
    return False


def finite_only(df: DataFrame) -> DataFrame:
    """df, failing when it runs on a number that isn't finite."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(name) | (F.abs(F.col(name)) == float("inf")), F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("boolean")).otherwise(True))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown."""
    got = rows.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)])


def lineage(df: DataFrame) -> DataFrame:
    """Files that a file-backed frame reads, with sizes and times."""
    return df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def transfer_seconds(size: Column, bits_per_second: float, delay: float) -> Column:
    """The cost model of a link: bytes * 8 / rate + delay."""
    return size * 8 / bits_per_second + delay
