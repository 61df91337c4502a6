"""Connected components of an edge table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: rows of a file, at 16 bytes each
EACH = 250_000


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step, over distinct edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    large = edges.join(low, edges["v"] == low["x"]).select("u", F.col("m").alias("v")).distinct()
    small = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    out = large.join(small, large["u"] == small["x"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, in files of about EACH rows: tables that get smaller by the round are else as many files as there are partitions, which cost more than what they hold."""
    parts = -(-rows // EACH)
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are stars around their smallest nodes: a node with a smaller neighbour has no other one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("m < u AND n > 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b), by alternating large-star and small-star steps.

    Each round is written to the shared folder; a node's smallest neighbour is found by partial aggregation, so a node with a
    third of all edges is no burden. Rounds, of which none has more edges than the one before, end when the edges are stars.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = scratch.save(cur, "edges")
    n = cur.count()
    if not n:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        if _settled(cur):
            break
        new = scratch.save(_few(_stars(cur), n), "edges")
        scratch.drop(cur)
        cur, n = new, new.count()
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return _few(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), 2 * n)
