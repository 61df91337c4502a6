"""Queries that write tables with this package's sinks and read them back with its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives
from ..sources.documents import register
from ..sources.shared import scratch_path
from .registry import query
from .views import table


@query("SELECT vec_id, round(list_dot_product(e, e), 6) AS square, round(e[1], 6) AS first, len(e) AS size FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def matrix_files(spark, sf):
    """Vectors as rows of .npy matrices (their id in front), published with a commit and read by ranges of rows."""
    register(spark)
    path = scratch_path(spark, "matrix")
    v = table(spark, sf, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("vec"))
    v.write.format("npy").mode("append").option("rowsPerFile", 150).save(path)
    back = spark.read.format("npy").option("partitionBytes", 1 << 15).load(path).select(F.col("vec")[0].cast("long").alias("vec_id"), F.slice("vec", 2, F.size("vec") - 1).alias("e"))
    return back.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), F.round(F.col("e")[0], 6).alias("first"), F.size("e").cast("long").alias("size"))


@query("SELECT source || '/' || doc_id || '.txt' AS member, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def archive_members(spark, sf):
    """Texts packed into ZIP archives with a commit, and their members' digests read back by ranges of the directories."""
    register(spark)
    path = scratch_path(spark, "archive")
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    d.write.format("zip").mode("append").option("archiveBytes", 1 << 20).save(path)
    return archives.members(spark, path, partitionBytes=1 << 19).select("member", "bytes", "sha256")
