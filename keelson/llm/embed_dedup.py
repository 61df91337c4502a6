"""Embedding near-duplicates by sorted projection passes.

1. Equal vectors are one class. In each pass a class gets a key, BITS signs of random projections put together, and a projection
   value; classes are sorted by pass, key and value over the cluster. Each is compared with the WINDOW classes
   that follow: rows of a stretch of the order, and the first WINDOW of the next stretch, are one group, so groups are bounded
   whatever the keys. Pairs of a cosine of LEAST or more, in double precision, are links; passes are united by components.
2. Windows are bounded, so in crowded places they leave links out. Keys with more classes than a window reaches are
   therefore cut into tiles, and all pairs of different components that share such a key are compared; one link for
   each two components leaves a task, and components are united again. This is quadratic in the classes of a key.
3. n_links is counted exactly within components: a component is cut into tiles, pairs of tiles are multiplied
   as matrices, and only counts leave a task. Links found between tiles are links of one component, so components stand.

With cosine 0.95 a pair agrees in all of 12 signs with a probability of 0.28 a pass, so over PASSES passes it shares
no key with a probability under 1e-3, at any size of the input and of the keys; a pair that shares one is linked or in one component.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths link with nothing of another length; rows that repeat a vec_id are one node each with its own vectors, and each row counts as a vector
for others; rows without vec_id have n_links, no component and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import Scratch, alone, table
from ._text import U, stream

PASSES, SIGNS, WINDOW, STRETCH, TILE = 24, 12, 24, 2_000, 1_000


def _directions(size: int, seed: int) -> np.ndarray:
    """PASSES x (SIGNS + 1) fixed directions of this many components, near enough normal: sums of uniform values."""
    n = PASSES * (SIGNS + 1) * size
    u = sum((stream(seed + 977 * k, n) >> U(11)).astype(np.float64) * 2.0**-53 for k in range(4)) - 2.0
    return u.reshape(PASSES * (SIGNS + 1), size)


def _units(col: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Rows with usable vectors, and these at length 1 in double precision."""
    rows, out = [], []
    for i, v in enumerate(col):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all() or not x.any():
            continue
        x = x / np.abs(x).max()
        rows.append(i)
        out.append(x / np.sqrt((x * x).sum()))
    return rows, out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, unit vector, and by pass the key and the value that it sorts by."""
    dirs: dict[int, np.ndarray] = {}
    for b in batches:
        rows, units = _units(b.column("embedding"))
        by: dict[int, list[int]] = {}
        for k, x in enumerate(units):
            by.setdefault(len(x), []).append(k)
        for size, own in by.items():
            for at in range(0, len(own), 1000):
                part = own[at : at + 1000]
                d = dirs.setdefault(size, _directions(size, 29))
                x = np.stack([units[k] for k in part])
                y = (x @ d.T).reshape(len(part), PASSES, SIGNS + 1)
                key = ((y[:, :, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column("cid")[rows[k]].as_py() for k in part], pa.int64()),
                        pa.array(list(x), pa.list_(pa.float64())),
                        pa.array([[{"pass": p, "key": int(k[p]), "value": float(v[p])} for p in range(PASSES)] for k, v in zip(key, y[:, :, SIGNS], strict=True)], pa.list_(pa.struct([("pass", pa.int32()), ("key", pa.int64()), ("value", pa.float64())]))),
                    ],
                    ["cid", "unit", "keys"],
                )


def _compared(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        rank, cid, pas = rows["rank"].to_numpy(), rows["cid"].to_numpy(), rows["pass"].to_numpy()
        own, a, b = rows["own"].to_numpy(), [], []
        for size in rows["size"].unique():
            of = np.flatnonzero(rows["size"].to_numpy() == size)
            x = np.stack(rows["unit"].iloc[of].to_list())
            for d in range(1, WINDOW + 1):
                i, j = of[:-d], of[d:]
                near = own[i] & (rank[j] - rank[i] <= WINDOW) & (pas[i] == pas[j]) & (cid[i] != cid[j])
                at = np.flatnonzero(near)
                ok = at[np.einsum("ij,ij->i", x[at], x[at + d]) >= least]
                a.append(np.minimum(cid[of[ok]], cid[of[ok + d]]))
                b.append(np.maximum(cid[of[ok]], cid[of[ok + d]]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _counted(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each class on side 0, the vectors on side 1 that it links with, in components of one length each."""
        rows = rows.sort_values(["component", "size", "side", "cid"])
        comp, size, side = (rows[k].to_numpy() for k in ("component", "size", "side"))
        cid, copies, unit = rows["cid"].to_numpy(), rows["copies"].to_numpy(), rows["unit"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (comp[1:] != comp[:-1]) | (size[1:] != size[:-1]), [True]]))
        n = np.zeros(len(rows), np.int64)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo < mid < hi:
                link = np.stack(unit[lo:mid]) @ np.stack(unit[mid:hi]).T >= least
                link &= cid[lo:mid, None] != cid[None, mid:hi]
                n[lo:mid] = link @ copies[mid:hi]
        return pd.DataFrame({"cid": cid[side == 0], "n": n[side == 0]})

    return run


def _crossing(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of tiles of keys, one linked pair for each two components."""
        rows = rows.sort_values(["pass", "key", "size", "side"])
        of = rows[["pass", "key", "size"]].to_numpy()
        side, cid, comp, unit = (rows[k].to_numpy() for k in ("side", "cid", "component", "unit"))
        edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]).any(1), [True]]))
        out = [np.zeros((0, 4), np.int64)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo == mid:
                continue
            at = lo if mid == hi else mid  # a tile with itself, or with another
            x = np.stack(unit[lo:mid])
            i, j = np.nonzero(x @ (x if at == lo else np.stack(unit[mid:hi])).T >= least)
            i, j = i + lo, j + at
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            i, j = np.where(comp[i] < comp[j], i, j), np.where(comp[i] < comp[j], j, i)
            out.append(np.stack([comp[i], comp[j], cid[i], cid[j]], 1))
        got = np.concatenate(out)
        _, first = np.unique(got[:, :2], axis=0, return_index=True)
        return pd.DataFrame({"a": got[first, 2], "b": got[first, 3]})

    return run


def _within_keys(keyed: DataFrame, comps: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components, of all pairs that share a key which holds more classes than windows reach."""
    rows = keyed.select("cid", F.size("unit").alias("size"), F.explode("keys").alias("k")).select("cid", "size", "k.pass", "k.key")
    rows = rows.join(comps, rows["cid"] == comps["node"], "left").select("cid", "size", "pass", "key", F.coalesce("component", "cid").alias("component"))
    by = ["pass", "key"]
    full = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("n") > WINDOW + 1) & (F.col("lo") < F.col("hi")))
    full = scratch.save(full.select(*by, "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "crowded")
    small = full.where("tiles = 1").agg(F.sum("n")).first()[0] or 0
    share = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64(*by), F.lit(max(1, -(-small // TILE))))).otherwise(F.xxhash64(*by))
    tile = F.pmod(F.xxhash64("cid", *by), F.col("tiles").cast("long")).cast("int")
    dealt = rows.join(full, by).select("cid", "component", "size", *by, share.alias("share"), (F.col("tiles") == 1).alias("one"), tile.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    dealt = dealt.select("cid", "component", "size", *by, "share", "one", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), (F.col("t") > F.col("u")).cast("int").alias("side"))
    met = dealt.join(keyed.select("cid", "unit"), "cid").groupBy("share", "one", "x", "y")
    return met.applyInPandas(_crossing(least), "a long, b long").distinct()


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    v = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"))
    member = scratch.save(v.select("vec_id", "h1", "h2"), "members")
    copies = member.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # a class goes by a number of its own, so that rows without vec_id have one too
    copies = scratch.save(copies.withColumn("cid", F.xxhash64("h1", "h2")), "copies")
    first = v.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).select(F.xxhash64("h1", "h2").alias("cid"), "embedding")
    keyed = scratch.save(first.mapInArrow(_keyed, "cid long, unit array<double>, keys array<struct<pass:int,key:long,value:double>>"), "keyed")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = keyed.select("cid", F.explode("keys").alias("k")).select("cid", "k.*").repartitionByRange(parts, "pass", "key", "value", "cid").sortWithinPartitions("pass", "key", "value", "cid")
    order = scratch.save(order.select("cid", "pass", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")), "order")
    # ranks from the sizes of partitions, of which there are as many as Spark was told
    sizes = order.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m0")).orderBy("part").collect()
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at - r["m0"]))
        at += r["n"]
    ranked = order.join(F.broadcast(spark.createDataFrame(base or [(0, 0)], "part int, base long")), "part").select("cid", "pass", (F.col("m") + F.col("base")).alias("rank"))
    stretch = F.floor(F.col("rank") / STRETCH)
    copy = F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.when((F.col("rank") % STRETCH < WINDOW) & (stretch > 0), F.struct((stretch - 1).alias("stretch"), F.lit(False).alias("own"))))
    placed = ranked.select("cid", "pass", "rank", F.explode(F.filter(copy, lambda x: x.isNotNull())).alias("s")).select("cid", "pass", "rank", "s.*")
    placed = placed.join(keyed.select("cid", "unit", F.size("unit").alias("size")), "cid")
    pairs = scratch.save(placed.groupBy("stretch").applyInPandas(_compared(least), "a long, b long").distinct(), "pairs")
    comps = scratch.save(connected_components(pairs, scratch), "components")
    more = scratch.save(_within_keys(keyed, comps, least, scratch), "more")
    if not more.isEmpty():
        comps = scratch.save(connected_components(pairs.unionByName(more), scratch), "components")
    # tiles: a component's classes by hash, TILE each on average; all pairs of its tiles. Components of one tile share groups
    in_comp = scratch.save(comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "sizes")
    small = in_comp.where("tiles = 1").agg(F.sum("n")).first()[0] or 0
    share = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, -(-small // TILE))))).otherwise(F.col("component"))
    tiled = comps.join(in_comp, "component").select(F.col("node").alias("cid"), "component", share.alias("share"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int").alias("tile"))
    tiled = scratch.save(tiled.join(keyed.select("cid", "unit", F.size("unit").alias("size")), "cid").join(copies.select("cid", "copies"), "cid"), "tiles")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    kept = ["cid", "component", "share", "tiles", "copies", "unit", "size"]
    sides = tiled.select(*kept, F.col("tile").alias("x"), F.explode(others).alias("y"), F.lit(0).alias("side")).unionByName(tiled.select(*kept, F.explode(others).alias("x"), F.col("tile").alias("y"), F.lit(1).alias("side")))
    counts = sides.groupBy("share", (F.col("tiles") == 1).alias("one"), "x", "y").applyInPandas(_counted(least), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    usable = keyed.select(F.col("cid").alias("cid"), F.lit(True).alias("usable"))
    of = copies.join(usable, "cid", "left").join(counts, "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    of = of.withColumn("component", F.coalesce("component", "cid"))
    lowest = of.groupBy("component").agg(F.min("rep").alias("lowest"))
    of = of.join(lowest, "component").select("h1", "h2", "usable", "copies", F.coalesce("n", F.lit(0)).alias("n"), "lowest")
    out = member.join(of.withColumnRenamed("h1", "_h1").withColumnRenamed("h2", "_h2"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    links = F.when(F.col("usable"), F.col("n") + F.col("copies") - 1).otherwise(0)
    comp = F.when(F.col("vec_id").isNotNull(), F.when(F.col("usable"), F.col("lowest")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(alone(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


SQL = """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u
      WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON node = vec_id LEFT JOIN d ON a = vec_id
"""
QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE_SQL = {"op6_embedding_dedup": SQL}
