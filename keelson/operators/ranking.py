"""Ranks, top-k, sampling and splits. Ties are broken by time, then index, everywhere."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIES = ("source_pts", "candidate_index")


def order(score: str, ties: Sequence[str] = TIES) -> list[Column]:
    return [F.col(score).desc(), *(F.col(c).asc() for c in ties)]


def stable_rank(df: DataFrame, keys: Sequence[str], score: str = "score", ties: Sequence[str] = TIES, name: str = "rank") -> DataFrame:
    """1-based rank by score from the top."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order(score, ties))))


def top_k(df: DataFrame, keys: Sequence[str], k: int, score: str = "score", ties: Sequence[str] = TIES) -> DataFrame:
    """The k best rows of each group (all of a shorter one), with step: their place in time order."""
    best = stable_rank(df, keys, score, ties, "_rank").where(F.col("_rank") <= k).drop("_rank")
    return best.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy(*ties)))


def stable_argmax(df: DataFrame, keys: Sequence[str], gain: str, ties: Sequence[str] = TIES) -> DataFrame:
    """The row of the largest gain of each group, without a sort."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col(gain), *ties)).alias("_row")).select("_row.*")


def uniform_rounded(df: DataFrame, keys: Sequence[str], k: int, ties: Sequence[str] = TIES) -> DataFrame:
    """min(k, n) rows at evenly spaced places, both ends included, halves rounded to even."""
    return _uniform(df, keys, k, ties, lambda x: F.rint(x))


def uniform_truncated(df: DataFrame, keys: Sequence[str], k: int, ties: Sequence[str] = TIES) -> DataFrame:
    """As uniform_rounded, with places cut to whole numbers."""
    return _uniform(df, keys, k, ties, lambda x: F.floor(x))


def _uniform(df: DataFrame, keys: Sequence[str], k: int, ties: Sequence[str], whole) -> DataFrame:
    by = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(*ties)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    m = F.least(F.col("_n"), F.lit(k))
    places = F.transform(F.sequence(F.lit(0), m - 1), lambda j: whole(F.when(m > 1, j * (F.col("_n") - 1) / (m - 1)).otherwise(0.0)).cast("long"))
    return rows.where(F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def strict_rank(df: DataFrame, keys: Sequence[str], score: str = "score", name: str = "below") -> DataFrame:
    """How many rows of the group score strictly less."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(score).asc())) - 1)


def fused_min(views: DataFrame, keys: Sequence[str], view: str, item: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """Best rank of an item over views, then the k best items, ties by time."""
    ranked = stable_rank(views, [*keys, view], score, item, "_r")
    best = ranked.groupBy(*keys, *item).agg(F.min("_r").alias("best_rank"))
    return best.withColumn("fused_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("best_rank", *item))).where(F.col("fused_rank") <= k)


def rank_product(df: DataFrame, keys: Sequence[str], first: str, second: str, ties: Sequence[str] = TIES) -> DataFrame:
    """1 / (rank by first * rank by second)."""
    both = stable_rank(stable_rank(df, keys, first, ties, "rank_1"), keys, second, ties, "rank_2")
    return both.withColumn("fused", F.lit(1.0) / (F.col("rank_1") * F.col("rank_2")))


def hash_split(df: DataFrame, key: str, text: Column, cuts: dict[str, int], rest: str = "rest") -> DataFrame:
    """Rows in the order of sha256 of text; the first so many of them to each part in turn, with their place.

    Only the rows that the parts take are ordered, as a distributed top-k; all others are the rest, without a place.
    """
    total = sum(cuts.values())
    first = df.select(F.col(key).alias("_key"), F.sha2(text, 256).alias("_hash")).orderBy("_hash", "_key").limit(total)
    first = first.select("_key", F.row_number().over(Window.orderBy("_hash", "_key")).alias("place"))
    part, upto = F.lit(rest), total
    for name, n in reversed(cuts.items()):
        part = F.when(F.col("place") <= upto, name).otherwise(part)
        upto -= n
    return df.join(first, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("part", part)


def numbered(df: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows numbered from 1 by bucket, then order. Rows of a bucket are sorted together; only the sizes of buckets, which must be few beside the rows, meet in one task."""
    before = F.sum("_n").over(Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).select(*bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return df.join(sizes, list(bucket)).withColumn(name, within + F.col("_before")).select(*df.columns, name)


def group_kfold(df: DataFrame, group: str, k: int, text: Column) -> DataFrame:
    """Rows with the fold of their group: place of the group by sha256 of text, modulo k. One row stands for a group, in 4,096 buckets by the digest's first digits."""
    digest = df.select(group, F.sha2(text, 256).alias("_digest")).distinct().withColumn("_range", F.substring("_digest", 1, 3))
    folds = numbered(digest, ["_range"], ["_digest"], "_place").select(group, ((F.col("_place") - 1) % k).cast("int").alias("fold"))
    return df.join(folds, group)


def first_per_stratum(df: DataFrame, stratum: str, n: int, order_by: Sequence[Column], once: str | None = None) -> DataFrame:
    """The first n rows of each stratum; once: only the first row of each value of that column counts."""
    if once:
        df = df.withColumn("_first", F.row_number().over(Window.partitionBy(once).orderBy(*order_by))).where("_first = 1").drop("_first")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order_by))).where(F.col("place") <= n)


def interleaved(df: DataFrame, stratum: str, place: str = "place") -> DataFrame:
    """Round-robin over strata: ordinal by place, then stratum."""
    return numbered(df, [place], [stratum], "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))


def pilots(df: DataFrame, item: str, order: Sequence[Column | str], n: int, more: Sequence[str] = ()) -> DataFrame:
    """item and place of the first n items in order, then of those named, each once. Both are few."""
    first = df.select(item, *order).distinct().orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(item, "place")
    named = df.where(F.col(item).isin(*more)).select(item).distinct().withColumn("place", n + F.array_position(F.array(*map(F.lit, more)), F.col(item)).cast("int"))
    return first.unionByName(named).groupBy(item).agg(F.min("place").alias("place"))


def duration_queue(df: DataFrame, item: str, duration: str, first: DataFrame) -> DataFrame:
    """Items with their ordinal: those of first by place, the others by falling duration, then by name. Buckets are places and whole durations."""
    queued = df.join(F.broadcast(first), item, "left").withColumn("_bucket", F.when(F.col("place").isNotNull(), F.col("place") - 2**40).otherwise(-F.floor(duration)).cast("long"))
    return numbered(queued, ["_bucket"], [F.desc(duration), item], "ordinal").drop("_bucket", "place")


def rotated(methods: Column, ordinal: Column) -> Column:
    """The list of methods begun at ordinal modulo its size."""
    at = F.pmod(ordinal, F.size(methods)).cast("int")
    return F.concat(F.slice(methods, at + 1, F.size(methods)), F.slice(methods, F.lit(1), at))


def longest_first(jobs: Sequence[tuple[str, float]], workers: int) -> dict[str, int]:
    """Longest job first, each to the least loaded worker (ties: lowest number). Job lists are small."""
    load, out = [(0.0, w) for w in range(workers)], {}
    for job, cost in sorted(jobs, key=lambda x: (-x[1], x[0])):
        total, w = heapq.heappop(load)
        out[job] = w
        heapq.heappush(load, (total + cost, w))
    return out


def review_queue(df: DataFrame, slot: str, priority: Sequence[str], kind: str, item: str, n: int) -> DataFrame:
    """First n items of each slot by the place of their kind in a priority list, then by item."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    rank = F.row_number().over(Window.partitionBy(slot).orderBy(F.when(place > 0, place).otherwise(len(priority) + 1), item))
    return df.dropDuplicates([slot, item]).withColumn("place", rank).where(F.col("place") <= n)
