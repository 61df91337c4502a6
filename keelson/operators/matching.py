"""Matches of rows within a key: mutual bests, Hamming neighbours, confirmed tokens and where a witness stands."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mutual_best(pairs: DataFrame, keys: Sequence[str], a: str, b: str, value: str) -> DataFrame:
    """Pairs (a, b) that are each other's unique largest positive value."""
    pos = pairs.where(F.col(value) > 0)
    for k in (a, b):
        w = Window.partitionBy(*keys, k)
        pos = pos.withColumn(f"_m{k}", F.max(value).over(w))
    for k in (a, b):
        pos = pos.withColumn(f"_n{k}", F.count_if(F.col(value) == F.col(f"_m{k}")).over(Window.partitionBy(*keys, k)))
    best = (F.col(value) == F.col(f"_m{a}")) & (F.col(value) == F.col(f"_m{b}")) & (F.col(f"_n{a}") == 1) & (F.col(f"_n{b}") == 1)
    return pos.where(best).select(*keys, a, b, value)


def sign_hash(vec: Column) -> Column:
    """The signs of the first 64 components as bits of a long, the first highest."""
    return F.aggregate(F.slice(vec, 1, 64), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def band_masks(bands: int) -> list[int]:
    """The 64 bits of a hash as so many runs of bits."""
    edges = [64 * k // bands for k in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def within_bits(a: DataFrame, b: DataFrame, keys: Sequence[str], most: int, bands: int | None = None) -> DataFrame:
    """keys, a, b, distance of hashes (long columns a and b) of two tables that differ in at most so many bits.

    Two such hashes have a band of bits in which they differ in no more than most // bands: they meet there, and nowhere else are rows paired. With most + 1 bands, the default, a band agrees
    as it is; with fewer, a's bands are sent out with every so small change. A pair counts in the first band in which it meets, so none is made twice. Equal rows of a table count once.
    """
    masks = band_masks(bands or most + 1)
    slack = most // len(masks)
    flips = lambda mask: [sum(x) for n in range(slack + 1) for x in combinations([1 << i for i in range(64) if mask >> i & 1], n)]
    ways = lambda small: F.array(*(F.struct(F.lit(k).alias("band"), _signed(m).alias("mask"), _signed(f).alias("flip")) for k, m in enumerate(masks) for f in (flips(m) if small else [0])))
    sent = lambda c, small: F.transform(ways(small), lambda w: F.struct(w["band"].alias("band"), F.col(c).bitwiseAND(w["mask"]).bitwiseXOR(w["flip"]).alias("bits")))
    x = a.select(*keys, "a").distinct().select(*keys, "a", F.inline(sent("a", True)))
    y = b.select(*keys, "b").distinct().select(*keys, "b", F.inline(sent("b", False)))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(masks))
    for k, m in reversed(list(enumerate(masks))):
        first = F.when(F.bit_count(differ.bitwiseAND(_signed(m))) <= slack, k).otherwise(first)
    met = x.join(y, [*keys, "band", "bits"]).withColumn("distance", F.bit_count(differ))
    return met.where((F.col("distance") <= most) & (first == F.col("band"))).select(*keys, "a", "b", "distance")


def hamming_pairs(df: DataFrame, keys: Sequence[str], item: str, value: str, most: int, bands: int | None = None) -> DataFrame:
    """Pairs of items of a key whose 64-bit hashes differ in at most so many bits. Items of one hash are paired after hashes are."""
    h = df.select(*keys, F.col(value).alias("a"))
    close = within_bits(h, h.withColumnRenamed("a", "b"), keys, most, bands or (most + 1 if most < 8 else most // 2 + 1)).withColumnsRenamed({"a": "_a", "b": "_b"})
    a, b = (df.select(*keys, F.col(item).alias(k), F.col(value).alias(f"_{k}")) for k in "ab")
    return close.join(a, [*keys, "_a"]).join(b, [*keys, "_b"]).where("a < b").select(*keys, "a", "b", "distance")


def common_length(a: Column, b: Column, most: int) -> Column:
    """Length of the longest common subsequence of two arrays of 64-bit hashes that match within most bits."""
    n = F.size(b)

    def row(before: Column, x: Column) -> Column:
        cell = lambda acc, j: F.greatest(F.get(before, j), F.element_at(acc, -1), F.get(before, j - 1) + (F.bit_count(x.bitwiseXOR(F.get(b, j - 1))) <= most).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), lambda acc, j: F.array_append(acc, cell(acc, j)))

    return F.when((F.size(a) > 0) & (n > 0), F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), n + 1), row), -1)).otherwise(0)


def clip_matches(queries: DataFrame, bank: DataFrame, clip: str, hashes: str, most: int = 6, least: int = 6, bands: int | None = None) -> DataFrame:
    """query, match and common of clips (arrays of hashes in time order) that share at least so many frames in order.

    First, by the banded index over distinct hashes: clips of which so many of the query's frames have a match anywhere; then the longest common subsequence of those only. A clip doesn't match itself.
    """
    side = lambda df, c, h: df.select(F.col(clip).alias(c), F.posexplode(hashes).alias(f"{c}_at", h))
    q, b = side(queries, "query", "a"), side(bank, "match", "b")
    close = within_bits(q.select("a"), b.select("b"), [], most, bands)
    met = q.join(close, "a").join(b, "b").where("query <> match").groupBy("query", "match").agg(F.count_distinct("query_at").alias("n")).where(F.col("n") >= least)
    whole = met.join(queries.select(F.col(clip).alias("query"), F.col(hashes).alias("_q")), "query").join(bank.select(F.col(clip).alias("match"), F.col(hashes).alias("_m")), "match")
    return whole.select("query", "match", common_length(F.col("_q"), F.col("_m"), most).alias("common")).where(F.col("common") >= least)


def confirmed_tokens(df: DataFrame, keys: Sequence[str], order: str, tokens: str) -> DataFrame:
    """tokens that the row before or the row after in its key has too."""
    w = Window.partitionBy(*keys).orderBy(order)
    none = F.array().cast("array<string>")
    beside = F.array_union(F.coalesce(F.lag(tokens).over(w), none), F.coalesce(F.lead(tokens).over(w), none))
    return df.withColumn("_beside", beside).withColumn("confirmed", F.array_sort(F.array_intersect(tokens, "_beside"))).drop("_beside")


def bracketed_tokens(fine: Column, before: Column, after: Column) -> Column:
    """Tokens of a fine row that the coarse rows on both sides have."""
    return F.array_sort(F.array_intersect(fine, F.array_intersect(before, after)))


def witness_state(pool: Column, place: Column, quota: Column, feasible: Column) -> Column:
    """Where a fact's witness stands: selected, reachable by a quota, beyond it, outside the prefix, or outside the pool."""
    return F.when(~F.coalesce(pool, F.lit(False)), "outside_legal_pool").when(place.isNull(), "outside_prefix").when(place <= quota, "selected").when(place <= feasible, "quota_reachable").otherwise("beyond_feasible_quota")


def suppressed(df: DataFrame, keys: Sequence[str], time: str, score: str, item: str, radius: int, most: int) -> DataFrame:
    """Positive-score rows by score, each at least radius away from all kept before it, most at most: a fold over the sorted rows of a key."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(time).alias("t"), F.col(item).alias("i"))))
    rows = df.where(F.col(score) > 0).groupBy(*keys).agg(ordered.alias("_rows"))
    clear = lambda kept, x: F.forall(kept, lambda y: F.abs(y["t"] - x["t"]) > radius)
    kept = F.aggregate("_rows", F.filter("_rows", lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) < most) & clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(*keys, F.posexplode(kept).alias("_k", "x")).select(*keys, F.col("x.i").alias(item), (F.col("_k") + 1).alias("step"))


def spread_pairs(rows: DataFrame, keys: Sequence[str], time: str, bins: int, low: Column, high: Column) -> DataFrame:
    """Occupied bins and the largest gap in time, ends included, of selections."""
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = rows.withColumn("_g", F.coalesce(F.col(time) - F.lag(time).over(w), F.col(time) - low)).withColumn("_e", high - F.col(time))
    share = F.when(high > low, (F.col(time) - low) / (high - low)).otherwise(0.0)
    return gaps.groupBy(*keys).agg(F.count_distinct(F.least(F.lit(bins - 1), F.floor(share * bins))).alias("bins"), F.greatest(F.max("_g"), F.min("_e")).alias("max_gap"), (F.max(time) - F.min(time)).alias("span"))
