"""JSON documents, each a file of its own, written with a commit: name string, json string. Texts that aren't JSON, and numbers that aren't finite, are an error, and leave nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from .archives import ArchiveBlocks, ArchiveSource, ZipSource, checked
from .committed import CommittedWriter
from .matrices import NpySource, NpzSource


class DocumentWriter(CommittedWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        def refuse(text: str):
            raise ValueError(f"{text} is no number of JSON")

        def number(text: str) -> float:
            return x if (x := float(text)) - x == 0 else refuse(text)

        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("json").to_pylist(), strict=True):
                checked(name, "/" in name or name.startswith("_"))
                value = json.loads(text, parse_constant=refuse, parse_float=number)
                yield f"{name}.json", 1, json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False).encode()


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return "name string, json string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make this package's formats known to a session."""
    for source in (NpySource, NpzSource, ArchiveSource, ArchiveBlocks, ZipSource, DocumentSource):
        spark.dataSource.register(source)
