"""Labelled rows that classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; never for a row without id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == rest, F.lit(False))


def training_rows(labels: DataFrame, label: str, modulus: int, rest: int, most: int) -> DataFrame:
    """doc_id, y of at most so many labelled documents that aren't held out, by a hash of the id.

    Documents with contradictory labels, and labels that are null, are left out. The bound makes it safe to broadcast.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"), modulus, rest))
    one = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").select("doc_id", "y")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text, y: the documents of rows, which must be bounded."""
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
