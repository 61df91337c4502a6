"""Bootstraps and permutation tests as aggregations: each draw's weights come from hashes of a unit's name and the draw's number.

A unit goes to no other: every task weighs its own units for all draws and adds them up, so units may be any number and only sums by draw are shuffled. The same hashes give the same draws
anywhere, in SQL too. Weights are Poisson(1) from 16 bits of an MD5 (eight draws a hash), which resamples units with replacement up to the number drawn; that is put right by the weights' sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EACH, SIGNS = 8, 128
#: of 65,536 values of 16 bits, those below step k have a weight of at most k
STEPS = [round(65_536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def _name(key: Column, seed: int, block: Column) -> Column:
    return F.concat_ws("/", F.lit(str(seed)), key.cast("string"), block.cast("string"))


def poisson_sums(units: DataFrame, key: Column, by: Sequence[str], measures: Sequence[str], draws: int, seed: int) -> DataFrame:
    """by, draw, w and each measure: sums over units of their weight, and of weight times measure. Rows of one key have the same weights."""
    h = F.md5(_name(F.col("_key"), seed, F.col("_block")).cast("binary"))
    # four hexadecimal digits a draw, read twelve at a time
    part = lambda g: F.conv(F.substring("_md5", 12 * g + 1, 12 if g < 2 else 8), 16, 10).cast("long").alias(f"_p{g}")
    u = lambda i: F.shiftright(f"_p{i // 3}", 16 * ((2 if i < 6 else 1) - i % 3)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    weight = lambda i: sum(((F.col(f"_u{i}") >= t).cast("int") for t in STEPS), F.lit(0))
    d = units.select(*by, *(F.col(m).cast("double").alias(m) for m in measures), key.alias("_key"))
    # few units make many rows: dealt out by number, or adaptive execution would leave them in one task
    d = d.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // EACH) - 1))))
    d = d.select(*by, *measures, "_block", h.alias("_md5")).select(*by, *measures, "_block", *map(part, range(3))).select(*by, *measures, "_block", *(u(i).alias(f"_u{i}") for i in range(EACH))).select(*by, *measures, "_block", *(weight(i).alias(f"_w{i}") for i in range(EACH)))
    sums = d.groupBy(*by, "_block").agg(*(F.sum(f"_w{i}").alias(f"_w{i}") for i in range(EACH)), *(F.sum(F.col(f"_w{i}") * F.col(m)).alias(f"_{m}{i}") for i in range(EACH) for m in measures))
    rows = F.array(*(F.struct((F.col("_block") * EACH + i).alias("draw"), F.col(f"_w{i}").alias("w"), *(F.col(f"_{m}{i}").alias(m) for m in measures)) for i in range(EACH)))
    return sums.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*").where(F.col("draw") < draws)


def _bounds(draws: DataFrame, value: str, facts: DataFrame) -> DataFrame:
    """facts (one row, or none) with the 2.5 and 97.5 percentiles of the draws."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    both = facts.unionByName(draws.agg(q[0].alias("low"), q[1].alias("high")), allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).where(F.col(facts.columns[0]).isNotNull())


def stratified_bootstrap(df: DataFrame, stratum: str, difference: str, reps: int = 10_000, seed: int = 2027) -> DataFrame:
    """n, mean, low and high: mean difference and its 2.5 and 97.5 percentiles, resampling rows within strata. Rows of a stratum that agree are numbered; a stratum of which a draw takes nothing stands as it is."""
    counted = df.groupBy(F.col(stratum).alias("_h"), F.col(difference).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d IS NOT NULL")
    units = counted.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    key = F.concat_ws("/", F.coalesce(F.col("_h").cast("string"), F.lit("")), F.round("d", 6).cast("decimal(20,6)").cast("string"), F.col("unit").cast("string"))
    strata = counted.groupBy(F.col("_h").alias("_s")).agg(F.sum("n").alias("_n"), F.sum(F.col("d") * F.col("n")).alias("_t"))
    draws = poisson_sums(units, key, ["_h"], ["d"], reps, seed).join(strata, F.col("_h").eqNullSafe(F.col("_s")))
    total = draws.groupBy("draw").agg((F.sum(F.when(F.col("w") > 0, F.col("d") * F.col("_n") / F.col("w")).otherwise(F.col("_t"))) / F.sum("_n")).alias("x"))
    facts = counted.agg(F.sum("n").alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean")).where("n IS NOT NULL")
    return _bounds(total, "x", facts)


def layered_cluster_bootstrap(df: DataFrame, layer: str, cluster: str, value: str, reps: int = 10_000, seed: int = 2027) -> DataFrame:
    """clusters, mean, low and high: the mean of value over rows, resampling clusters within their layers: of each draw the ratio of the sums to the sizes of the drawn clusters."""
    rows = df.select(F.col(layer).alias("_h"), F.col(cluster).alias("_c"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sums = rows.groupBy("_h", "_c").agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("/", F.coalesce(F.col("_h").cast("string"), F.lit("")), F.coalesce(F.col("_c").cast("string"), F.lit("")))
    layers = sums.groupBy(F.col("_h").alias("_l")).agg(F.count(F.lit(1)).alias("_k"), F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    draws = poisson_sums(sums, key, ["_h"], ["s", "n"], reps, seed).join(layers, F.col("_h").eqNullSafe(F.col("_l")))
    even = lambda c, all_: F.when(F.col("w") > 0, F.col(c) * F.col("_k") / F.col("w")).otherwise(F.col(all_).cast("double"))
    total = draws.groupBy("draw").agg((F.sum(even("s", "_s")) / F.sum(even("n", "_n"))).alias("x"))
    return _bounds(total, "x", sums.agg(F.count(F.lit(1)).alias("clusters"), (F.sum("s") / F.sum("n")).alias("mean")).where("clusters > 0"))


def equal_cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int = 10_000, seed: int = 2027) -> DataFrame:
    """clusters, mean, low and high: the mean over clusters of their means of value, each cluster alike whatever its size, resampling clusters."""
    rows = df.select(F.col(cluster).alias("_c"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    means = rows.groupBy("_c").agg(F.avg("_v").alias("x"))
    draws = poisson_sums(means, F.coalesce(F.col("_c").cast("string"), F.lit("")), [], ["x"], reps, seed).where("w > 0").select((F.col("x") / F.col("w")).alias("x"))
    return _bounds(draws, "x", means.agg(F.count(F.lit(1)).alias("clusters"), F.avg("x").alias("mean")).where("clusters > 0"))


def cluster_bootstrap(df: DataFrame, cluster: str, task: str | None, value: str, reps: int = 10_000, seed: int = 2027) -> DataFrame:
    """clusters, mean, low and high: the mean of task means (without a task, the mean over all rows), resampling clusters, which keep their rows of all tasks. Draws without some task don't count."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(cluster).alias("_c"), (F.coalesce(F.col(task).cast("string"), F.lit("")) if task else F.lit("")).alias("_t"), F.col(value).cast("double").alias("_v"))
    sums = rows.groupBy("_c", "_t").agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("n"))
    n = sums.select("_t").distinct().count()
    facts = sums.groupBy("_t").agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.avg("m").alias("mean")).where("mean IS NOT NULL")
    facts = facts.select(F.lit(sums.select("_c").distinct().count()).cast("long").alias("clusters"), "mean")
    draws = poisson_sums(sums, F.coalesce(F.col("_c").cast("string"), F.lit("")), ["_t"], ["s", "n"], reps, seed).where("n > 0").groupBy("draw").agg(F.count(F.lit(1)).alias("_k"), F.avg(F.col("s") / F.col("n")).alias("x"))
    return _bounds(draws.where(F.col("_k") == n), "x", facts)


def sign_flips(df: DataFrame, by: Sequence[str], cluster: str, difference: str, reps: int = 10_000, seed: int = 2027, exact: int = 12) -> DataFrame:
    """by, clusters, difference, draws, at_least and p: whether paired differences could be chance. Under the null, each cluster's sum of differences has either sign.

    Groups of at most `exact` clusters are enumerated: all 2^n sign patterns, of which the observed is one, so p = at_least / draws. Others take reps draws by hashes of the cluster's name
    (128 signs a hash): p = (1 + at_least) / (1 + draws). at_least: draws whose total is as far from 0 as the observed, or farther. Differences are whole numbers, or exact in doubles.
    """
    sums = df.where(F.col(difference).isNotNull()).groupBy(*by, F.col(cluster).alias("_c")).agg(F.sum(F.col(difference).cast("double")).alias("_s"))
    facts = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.sum("_s").alias("difference"))
    ids = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    of = facts.withColumnsRenamed({c: f"_by_{c}" for c in by})
    sized = sums.join(of, reduce(lambda x, y: x & y, ids)).drop(*(f"_by_{c}" for c in by))
    few, many = sized.where(F.col("clusters") <= exact), sized.where(F.col("clusters") > exact)
    # at most `exact` rows a group, so the window is small; the pattern's bits are the signs
    bit = F.row_number().over(Window.partitionBy(*by).orderBy("_c")) - 1
    two = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    each = few.withColumn("bit", bit).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), two(F.col("clusters")) - 1)))
    signed = each.select(*by, "difference", "draw", F.when(F.getbit("draw", F.col("bit")) == 1, -F.col("_s")).otherwise(F.col("_s")).alias("_s"))
    blocks = -(-reps // SIGNS)
    h = F.unhex(F.md5(_name(F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, "_c"))), seed, F.col("_block")).cast("binary")))
    hashed = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("_h", h)
    # signs of a block as columns of sums: 128 sums by group and block are what a task sends
    byte = lambda i: F.conv(F.hex(F.substring("_h", i // 8 + 1, 1)), 16, 10).cast("int")
    sign = lambda i: F.when(F.getbit(byte(i), F.lit(i % 8)) == 1, -F.col("_s")).otherwise(F.col("_s"))
    added = hashed.groupBy(*by, "difference", "_block").agg(*(F.sum(sign(i)).alias(f"_t{i}") for i in range(SIGNS)))
    drawn = added.select(*by, "difference", "_block", F.posexplode(F.array(*(f"_t{i}" for i in range(SIGNS)))).alias("_i", "_s")).withColumn("draw", F.col("_block") * SIGNS + F.col("_i")).where(F.col("draw") < reps)
    totals = signed.groupBy(*by, "difference", "draw").agg(F.sum("_s").alias("_s")).unionByName(drawn.select(*by, "difference", "draw", "_s"))
    told = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.count_if(F.abs("_s") >= F.abs("difference")).alias("at_least"))
    p = F.when(F.col("clusters") <= exact, F.col("at_least") / F.col("draws")).otherwise((F.col("at_least") + 1) / (F.col("draws") + 1))
    told = told.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return facts.join(told, reduce(lambda x, y: x & y, ids)).select(*by, "clusters", "difference", "draws", "at_least", p.alias("p"))
