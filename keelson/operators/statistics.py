"""Accuracy tables, paired comparisons, distributions and bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clipped, cosine
from .resampling import cluster_bootstrap, equal_cluster_bootstrap, layered_cluster_bootstrap, sign_flips, stratified_bootstrap  # noqa: F401

Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds of a share, within 0 and 1."""
    p = k / n
    d = 1 + Z * Z / n
    mid, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def accuracy(df: DataFrame, stratum: str, correct: str = "correct") -> DataFrame:
    """n, k, accuracy and bounds by stratum and over all; strata without rows are absent, null counts as wrong."""
    k, n = F.sum(F.coalesce(F.col(correct).cast("long"), F.lit(0))), F.count(F.lit(1))
    by = df.rollup(stratum).agg(n.alias("n"), k.alias("k"), F.grouping(stratum).alias("_all"))
    low, high = wilson(F.col("k"), F.col("n"))
    return by.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(stratum)).alias("stratum"), "n", "k", (F.col("k") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"))


def macro_average(df: DataFrame, task: str, tasks: int, correct: str = "correct") -> DataFrame:
    """Unweighted mean of task accuracies times 100; no row unless there are so many tasks."""
    each = df.groupBy(task).agg(F.avg(F.coalesce(F.col(correct).cast("double"), F.lit(0.0))).alias("a"))
    return each.agg(F.count(F.lit(1)).alias("tasks"), (100 * F.avg("a")).alias("macro")).where(F.col("tasks") == tasks)


def paired(left: DataFrame, right: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Rows of both methods with their cell: both, left, right or none."""
    l_, r = F.coalesce(F.col("_l"), F.lit(False)), F.coalesce(F.col("_r"), F.lit(False))
    cell = F.when(l_ & r, "both").when(l_, "left").when(r, "right").otherwise("none")
    return left.withColumnRenamed(correct, "_l").join(right.select(key, F.col(correct).alias("_r")), key).withColumn("cell", cell).drop("_l", "_r")


def paired_difference(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of cells and the difference of accuracies in points."""
    count = lambda x: F.count_if(F.col("cell") == x)
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(count(x).alias(f"n_{x}") for x in ("both", "left", "right", "none")), (100.0 * (count("left") - count("right")) / F.count(F.lit(1))).alias("difference"))


def patterns(results: DataFrame, key: str, profile: str, profiles: Sequence[str], correct: str = "correct") -> DataFrame:
    """The string of 0 and 1 of each key over profiles, only for keys that have them all."""
    wide = results.groupBy(key).pivot(profile, list(profiles)).agg(F.max(F.col(correct).cast("int")))
    have = F.lit(True)
    for p in profiles:
        have &= F.col(f"`{p}`").isNotNull()
    return wide.where(have).select(key, F.concat(*(F.col(f"`{p}`").cast("string") for p in profiles)).alias("pattern"))


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, linear-interpolated p50, p90 and p95, min and max."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p95"), F.min(value).alias("min"), F.max(value).alias("max"))


def histogram_entropy(df: DataFrame, keys: Sequence[str], share: Column, bins: int = 32) -> DataFrame:
    """Occupied bins and normalised entropy of shares of a duration."""
    counted = df.withColumn("_bin", F.least(F.lit(bins - 1), F.floor(share * bins))).groupBy(*keys, "_bin").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    return counted.withColumn("_p", p).groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), (-F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.lit(bins))).alias("entropy"))


def adjacent_change(df: DataFrame, keys: Sequence[str], order: str, vec: str) -> DataFrame:
    """Median and p90 of 1 - clipped cosine from one row to the next."""
    before = F.lag(vec).over(Window.partitionBy(*keys).orderBy(order))
    rows = df.withColumn("_before", before).where("_before IS NOT NULL").withColumn("_c", 1 - clipped(cosine(F.col("_before"), F.col(vec))))
    q = F.percentile("_c", F.array(F.lit(0.5), F.lit(0.9)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q[0].alias("median"), q[1].alias("p90"))


def pairwise_cosine(df: DataFrame, keys: Sequence[str], item: str, vec: str) -> DataFrame:
    """Quantiles of the cosines of all pairs within a group of bounded size."""
    a, b = (df.select(*keys, F.col(item).alias(f"_{k}"), F.col(vec).alias(f"_v{k}")) for k in "ab")
    pairs = a.join(b, list(keys)).where("_a < _b").withColumn("_c", cosine(F.col("_va"), F.col("_vb")))
    q = F.percentile("_c", F.array(*(F.lit(x) for x in (0.0, 0.1, 0.5, 0.9, 1.0))))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *(q[i].alias(n) for i, n in enumerate(("q0", "q10", "q50", "q90", "q100"))))


def preference(df: DataFrame, question: str, label: str, score: str, band: float = 1e-8) -> DataFrame:
    """Of each question, the mean over (right, wrong) pairs of 1, 1/2 within the band, or 0."""
    good, bad = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    d = F.col("_g") - F.col("_b")
    won = F.when(F.abs(d) <= band, 0.5).when(d > 0, 1.0).otherwise(0.0)
    return good.select(question, F.col(score).alias("_g")).join(bad.select(question, F.col(score).alias("_b")), question).groupBy(question).agg(F.count(F.lit(1)).alias("pairs"), F.avg(won).alias("preference"))


def group_divergences(df: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, js of each two groups (a before b): the Jensen-Shannon divergence over ln 2, within 0 and 1, of how their rows are spread over items. An item that one group lacks adds half of the other's share, so only
    items that both have are joined. Groups without a common item, which differ by 1, are not listed.
    """
    n = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).count()
    p = n.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("g")))
    a, b = p.select(F.col("g").alias("a"), "i", "p"), p.select(F.col("g").alias("b"), "i", F.col("p").alias("q"))
    half = lambda x: F.col(x) * F.ln(2 * F.col(x) / (F.col("p") + F.col("q")))
    met = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(half("p") + half("q")).alias("s"), F.sum("p").alias("pa"), F.sum("q").alias("qb"))
    js = (F.col("s") / F.ln(F.lit(2.0)) + 2 - F.col("pa") - F.col("qb")) / 2
    return met.select("a", "b", F.least(F.greatest(js, F.lit(0.0)), F.lit(1.0)).alias("js"))
