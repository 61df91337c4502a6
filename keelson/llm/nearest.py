"""Exact nearest neighbours by largest inner product, as a block matrix join.

1. Rows that agree in vector are one class, with its smallest k + 1 ids: of equal scores no others can be among a query's k nearest, its own
   id left out. Ids are ranked before the shuffle, so a vector that a third of all rows share sends k + 1 rows a task.
2. Queries and classes are dealt to blocks by hashes of their ids; each pair of blocks meets as one tile. Blocks are bounded by rows and bytes.
3. In a tile, vectors become int8 codes with a scale each, and blocks of codes are multiplied (integers below 2^24, so float32 products are exact).
   With x = s c + e, the product of codes is off by at most |e_q| |x| + |s c_q| |e_x|, and rounding is allowed for. A pair whose upper
   bound lies below the query's (k + 1)th largest lower bound, over all of the tile seen so far, can't be among its nearest.
4. Pairs that are left are computed from the original vectors in double precision, component by component in order, and kept in a heap of
   k + 1 classes a query. What tiles send on is k rows a query; a ranked window merges these over the tiles.

Every query meets every block: the work is queries times rows, by intent. Results are exact, so recall is 1.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id, take no part; vectors of
different lengths are never compared; rows equal in vec_id and vector count once; a vec_id with several vectors has a list of its own for each as
a query, an entry for each as a candidate, and is never its own candidate; scores that overflow are what doubles give, and what is no number comes
last; an empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table

QUERY_ROWS, CLASS_ROWS, BYTES, STRIP = 4_096, 16_384, 1 << 26, 512
#: components of which int8 products add up to less than 2^24
EXACT = (1 << 24) // (127 * 127)


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows of x, their scales, and bounds on the lengths of the rows, of scaled codes, and of what these leave."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # of subnormal rows: codes are 0 then, and the rest is the row
    code = np.clip(np.rint(x / scale[:, None]), -127, 127)
    near = code * scale[:, None]
    size = lambda y: np.sqrt((y * y).sum(1)) * (1 + 1e-12) + 1e-300
    return code.astype(np.int8), scale, size(x), size(near), size(x - near)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows of two blocks of codes, exact, as doubles."""
    out = None
    for at in range(0, a.shape[1], EXACT):
        part = a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
        out = part.astype(np.float64) if out is None else out + part
    return out


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows at the same place, added up in the order of components."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def nearest_in_tile(q: np.ndarray, x: np.ndarray, k: int, first: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """Of each row of q the k + 1 rows of x of largest product, at least: (-score, first, row), in order; ties to smaller first."""
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in q]
    with np.errstate(all="ignore"):
        qc, qs, qn, qm, qe = quantised(q)
        xc, xs, xn, _, xe = quantised(x)
        slack = 4 * (q.shape[1] + 8) * 2.0**-53
        bar = np.full((len(q), k + 1), -np.inf)  # the largest lower bounds so far
        for at in range(0, len(x), STRIP):
            s = slice(at, at + STRIP)
            mid = int8_products(qc, xc[s]) * qs[:, None] * xs[None, s]
            off = qe[:, None] * xn[None, s] + qm[:, None] * xe[None, s] + slack * qn[:, None] * xn[None, s]
            low = mid - off
            low[~np.isfinite(low)] = -np.inf
            bar = np.partition(np.concatenate([bar, low], 1), -(k + 1), axis=1)[:, -(k + 1) :]
            i, j = np.nonzero(~(mid + off < bar.min(1)[:, None]))
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)] + at
                score = inner(q[a], x[b])
                key = np.where(np.isnan(score), np.inf, -score)
                for r, v, c, p in zip(a.tolist(), key.tolist(), first[b].tolist(), b.tolist(), strict=True):
                    entry = (-v, -c, p)  # the worst of the kept is at the top
                    if len(heaps[r]) <= k:
                        heapq.heappush(heaps[r], entry)
                    elif entry > heaps[r][0]:
                        heapq.heapreplace(heaps[r], entry)
    return [sorted((-v, -c, p) for v, c, p in h) for h in heaps]


def _matrix(col: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]).astype(np.float64).reshape(-1, size)


def _tile(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            size = key[0].as_py()
            ids = right.column("ids").to_pylist()
            found = nearest_in_tile(_matrix(left.column("vector"), size), _matrix(right.column("vector"), size), k, np.array([x[0] for x in ids], np.int64))
            x, q = _matrix(right.column("vector"), size), _matrix(left.column("vector"), size)
            for r, (own, tag) in enumerate(zip(left.column("query_id").to_pylist(), left.column("query_key").to_pylist(), strict=True)):
                rows = [(v, i, p) for v, _, p in found[r] for i in ids[p] if i != own]
                for v, i, p in heapq.nsmallest(k, rows):
                    out["query_id"].append(own)
                    out["query_key"].append(tag)
                    out["vec_id"].append(i)
                    out["score"].append(-v if np.isfinite(v) else float(inner(q[r : r + 1], x[p : p + 1])[0]))
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("query_key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries (vec_id, embedding) the k rows of vectors of largest inner product that don't have its id."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    part = lambda df, name: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias(name), F.col("embedding").alias("vector")).distinct()
    place = Window.partitionBy("vector").orderBy("id")
    few = part(vectors, "id").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    classes = scratch.save(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("size", F.size("vector")), "classes")
    asked = scratch.save(part(queries, "query_id").withColumn("query_key", F.unhex(F.md5(F.to_json(F.struct("vector"))))).withColumn("size", F.size("vector")), "queries")
    n, wide = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    m, rows = asked.count(), max(64, BYTES // (8 * wide))
    down = max(1, -(-m // min(QUERY_ROWS, rows)))
    # at least as many tiles as tasks, if there are rows enough; results don't depend on it
    across = max(1, -(-n // min(CLASS_ROWS, rows)), min(n // 1_024, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // down)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = asked.select("query_id", "query_key", "vector", "size", block(F.col("query_id"), down).alias("qb"), every(across).alias("cb"))
    right = classes.select("ids", "vector", "size", block(F.col("ids")[0], across).alias("cb"), every(down).alias("qb"))
    by = ["size", "qb", "cb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_tile(k), "query_id long, query_key binary, vec_id long, score double")
    worst = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(worst.desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = alone(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(v, v.where("vec_id % 20 = 0"))


SQL = """
WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, e FROM u WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
QUERIES = {"op11_nearest": op11_nearest}
ORACLE_SQL = {"op11_nearest": SQL}
