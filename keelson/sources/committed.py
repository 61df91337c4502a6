"""Sinks that publish files only when all tasks are done: tasks write below a folder of their job, the commit moves what they name and replaces a manifest.

A manifest lists each file with its rows, bytes and SHA-256. Readers go by it, so files of a job that failed, or of tasks that ran twice, are never seen; an abort removes the job's folder.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

MANIFEST, JOBS = "_manifest.json", "_temporary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    at, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return at, inner.rstrip("/")


@dataclass(frozen=True)
class Written:
    name: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Parts(WriterCommitMessage):
    """What one task has written: the name below the job's folder and what it is to be."""

    files: list[tuple[str, Written]]


def read_manifest(path: str) -> list[Written] | None:
    """The files that are published at a path, or None if it has no manifest."""
    at, inner = place(path)
    if at.get_file_info(f"{inner}/{MANIFEST}").type != fs.FileType.File:
        return None
    with at.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return [Written(**x) for x in json.loads(f.read())["files"]]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, bytes, sha256 of the published files."""
    return spark.createDataFrame([tuple(asdict(x).values()) for x in read_manifest(path) or []], "name string, rows long, bytes long, sha256 string")


class CommittedWriter(DataSourceArrowWriter):
    """Writes what files() makes of a partition's batches. files() yields (name or None, rows, content); without a name, the part's number and suffix are one."""

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        # made here, on the driver, and nowhere else: a task that is late when the job is aborted finds it gone and fails, so nothing comes back
        at, inner = place(path)
        at.create_dir(f"{inner}/{JOBS}/{self.job}", recursive=True)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        at, inner = place(self.path)
        here = TaskContext.get()
        folder = f"{inner}/{JOBS}/{self.job}/{here.partitionId():05d}-{here.taskAttemptId()}"
        at.create_dir(folder, recursive=False)
        out: list[tuple[str, Written]] = []
        for k, (name, rows, content) in enumerate(self.files(iterator)):
            temporary = f"{folder}/{k:05d}"
            with at.open_output_stream(temporary) as f:
                f.write(content)
            out.append((temporary, Written(name or f"part-{here.partitionId():05d}-{k:05d}-{self.job[:8]}{self.suffix}", rows, len(content), hashlib.sha256(content).hexdigest())))
        return Parts(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, inner = place(self.path)
        new = [x for m in messages if m is not None for x in m.files]
        old = [] if self.overwrite else read_manifest(self.path) or []
        names = [w.name for _, w in new] + [w.name for w in old]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two files of one name")
        # a reader still goes by the manifest that is there: names of a job are its own unless rows give them
        gone = [w.name for w in (read_manifest(self.path) or [])] if self.overwrite else []
        for temporary, w in new:
            at.move(temporary, f"{inner}/{w.name}")
        text = json.dumps({"files": [asdict(w) for w in (*old, *(w for _, w in new))]}, sort_keys=True, allow_nan=False)
        with at.open_output_stream(f"{inner}/{JOBS}/{self.job}/{MANIFEST}") as f:
            f.write(text.encode())
        at.move(f"{inner}/{JOBS}/{self.job}/{MANIFEST}", f"{inner}/{MANIFEST}")
        for name in set(gone) - {w.name for _, w in new}:
            at.delete_file(f"{inner}/{name}")
        self._sweep(at, inner)  # with what tasks left that ran twice

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep(*place(self.path))

    def _sweep(self, at: fs.FileSystem, inner: str) -> None:
        own, every = f"{inner}/{JOBS}/{self.job}", f"{inner}/{JOBS}"
        for left in range(9, -1, -1):
            try:
                if at.get_file_info(own).type == fs.FileType.Directory:
                    at.delete_dir(own)
                break
            except OSError:  # a task that hasn't ended yet wrote just now
                if not left:
                    raise
                time.sleep(0.1)
        if at.get_file_info(every).type == fs.FileType.Directory and not at.get_file_info(fs.FileSelector(every)):
            at.delete_dir(every)


def published(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at a path: those of its manifest, or else all files of this suffix in the folder; a path of a file is that file."""
    at, inner = place(path)
    info = at.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    found = read_manifest(path)
    if found is not None:
        return [(f"{inner}/{w.name}", w.bytes) for w in found if w.name.endswith(suffix)]
    return sorted((x.path, x.size) for x in at.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(suffix) and f"/{JOBS}/" not in x.path)


