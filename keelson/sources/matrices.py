"""Dense matrices in .npy and .npz files, read by ranges of rows and written with a commit. No pickled objects, either way.

spark.read.format("npy").load(path): path, array, row, vec. A matrix is read by as many tasks as its bytes ask for (option partitionBytes); what is stored in an .npz as it is,
is read by ranges as well, and a compressed array by one task, as a stream. One-dimensional arrays have vectors of one value.
df.write.format("npy").mode(...).save(path): one column of arrays of numbers (option column, else vec); each task's rows in files of at most rowsPerFile, in the order that they have.
df.write.format("npz").mode(...).save(path): name string, shape array<long>, values array<double>; each task's arrays in one archive.
"""

from __future__ import annotations

import math
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .committed import CommittedWriter, place, published

READ_ROWS = 4_096


@dataclass
class Rows(InputPartition):
    """Rows of one array: the file, the array's name there, where its numbers start (None: compressed), kind of number, columns, and the rows."""

    path: str
    array: str
    start: int | None
    kind: str
    columns: int
    first: int
    last: int


def npy_header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether by columns, and kind of number of the array that starts here; f then stands at its numbers."""
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"version {version} of .npy files isn't known")
    return read(f)


def _usable(path: str, shape: tuple[int, ...], by_columns: bool, kind: np.dtype) -> None:
    if kind.hasobject:
        raise ValueError(f"{path}: pickled objects are not read")
    if kind.kind not in "fiub" or len(shape) not in (1, 2) or (by_columns and len(shape) == 2 and min(shape) > 1):
        raise ValueError(f"{path}: not a matrix of numbers by rows: {shape} of {kind}")


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", 1 << 26))

    def partitions(self) -> list[Rows]:
        out: list[Rows] = []
        at, _ = place(self.path)
        for path, _ in published(self.path, ".npy") + ([] if self.path.endswith(".npy") else published(self.path, ".npz") if not self.path.endswith(".npz") else []):
            with at.open_input_file(path) as f:
                if path.endswith(".npz"):
                    out += self._archive(path, f)
                else:
                    out += self._array(path, "", npy_header(f), f.tell())
        return out or [Rows("", "", 0, "", 0, 0, 0)]

    def _array(self, path: str, name: str, header, start: int | None) -> Iterator[Rows]:
        shape, by_columns, kind = header
        _usable(f"{path} {name}".strip(), shape, by_columns, kind)
        wide = shape[1] if len(shape) == 2 else 1
        step = shape[0] if start is None else max(1, self.bytes // max(1, wide * kind.itemsize))
        return (Rows(path, name, start, kind.str, wide, a, min(a + step, shape[0])) for a in range(0, shape[0], max(1, step)))

    def _archive(self, path: str, f) -> Iterator[Rows]:
        with zipfile.ZipFile(f) as z:
            for item in z.infolist():
                if not item.filename.endswith(".npy"):
                    continue
                with z.open(item) as array:
                    header, used = npy_header(array), array.tell()
                start = None
                if item.compress_type == zipfile.ZIP_STORED:
                    f.seek(item.header_offset)
                    local = f.read(30)
                    start = item.header_offset + 30 + sum(struct.unpack("<HH", local[26:30])) + used
                yield from self._array(path, item.filename[: -len(".npy")], header, start)

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        if p.first == p.last:
            return
        at, _ = place(self.path)
        kind = np.dtype(p.kind)
        with at.open_input_file(p.path) as f:
            if p.start is None:
                with zipfile.ZipFile(f) as z, z.open(f"{p.array}.npy") as array:
                    npy_header(array)
                    yield from self._batches(p, kind, array)
            else:
                f.seek(p.start + p.first * p.columns * kind.itemsize)
                yield from self._batches(p, kind, f)

    def _batches(self, p: Rows, kind: np.dtype, f) -> Iterator[pa.RecordBatch]:
        for a in range(p.first, p.last, READ_ROWS):
            n = min(READ_ROWS, p.last - a)
            raw = f.read(n * p.columns * kind.itemsize)
            if len(raw) < n * p.columns * kind.itemsize:
                raise ValueError(f"{p.path} ends early")
            x = np.frombuffer(raw, kind).astype(np.float64)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.columns), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array([p.array] * n), pa.array(np.arange(a, a + n)), vec], ["path", "array", "row", "vec"])


class NpyWriter(CommittedWriter):
    suffix = ".npy"

    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.column, self.rows = options.get("column", "vec"), int(options.get("rowsPerFile", 65_536))
        kind = schema[self.column].dataType.elementType.typeName()
        self.kind = {"float": np.float32, "double": np.float64, "integer": np.int32, "long": np.int64}[kind]

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[None, int, bytes]]:
        held: list[np.ndarray] = []
        n, wide = 0, None
        for b in batches:
            col = b.column(b.schema.get_field_index(self.column))
            size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, int)
            if col.null_count or col.flatten().null_count or (len(size) and (size != (wide or size[0])).any()):
                raise ValueError("rows of a matrix have as many numbers each, and no nulls")
            if not len(size):
                continue
            wide = int(size[0])
            x = col.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(-1, wide)
            while n + len(x) >= self.rows:
                yield None, self.rows, self._file([*held, x[: self.rows - n]])
                x, held, n = x[self.rows - n :], [], 0
            held.append(x)
            n += len(x)
        if n:
            yield None, n, self._file(held)

    def _file(self, held: list[np.ndarray]) -> bytes:
        out = BytesIO()
        np.save(out, np.concatenate(held), allow_pickle=False)
        return out.getvalue()


class NpzWriter(CommittedWriter):
    suffix = ".npz"

    def __init__(self, options: dict, schema, overwrite: bool):
        super().__init__(options["path"], overwrite)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[None, int, bytes]]:
        out, n = BytesIO(), 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for b in batches:
                for row in b.to_pylist():
                    x = np.array(row["values"], np.float64)
                    if len(x) != math.prod(row["shape"]):
                        raise ValueError(f"{row['name']}: {len(x)} values aren't of shape {row['shape']}")
                    if f"{row['name']}.npy" in z.NameToInfo:
                        raise ValueError(f"two arrays named {row['name']}")
                    with z.open(zipfile.ZipInfo(f"{row['name']}.npy"), "w", force_zip64=True) as f:
                        np.lib.format.write_array(f, x.reshape(row["shape"]), allow_pickle=False)
                    n += 1
        if n:
            yield None, n, out.getvalue()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, array string, row long, vec array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, schema, overwrite)


class NpzSource(NpySource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, schema, overwrite)
