"""Report tables: profiles by grouping sets, gates, out-of-fold comparisons, costs, annotations and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import merge_intervals, range_join


def profile(df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """measures by each grouping set in one pass; columns outside a set are 'all'."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(m.alias(k) for k, m in measures.items()), *(F.grouping(c).alias(f"_g_{c}") for c in columns))
    return out.select(*(F.when(F.col(f"_g_{c}") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in columns), *measures)


def common_failures(wide: DataFrame, methods: Sequence[str], category: str) -> DataFrame:
    """By category: rows, rows that every method gets wrong, and errors of each."""
    wrong = lambda m: ~F.coalesce(F.col(m), F.lit(False))
    every = F.lit(True)
    for m in methods:
        every = every & wrong(m)
    return wide.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(every).alias("common"), *(F.count_if(wrong(m)).alias(f"wrong_{m}") for m in methods))


def out_of_fold(df: DataFrame, question: str, fold: str, method: str, score: str, correct: str) -> DataFrame:
    """Right answers of the choice by score, of the method that is best outside a question's fold, and of the oracle."""
    c = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    sums = df.groupBy(fold, method).agg(F.sum(c).alias("k"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(method)
    rate = sums.withColumn("_r", (F.sum("k").over(every) - F.col("k")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0)))
    fixed = rate.groupBy(fold).agg(F.min_by(method, F.struct(-F.coalesce("_r", F.lit(-1.0)), F.col(method))).alias("_fixed"))
    rows = df.join(fixed, fold).groupBy(question).agg(F.min_by(c, F.struct(-F.col(score), F.col(method))).alias("chosen"), F.max(F.when(F.col(method) == F.col("_fixed"), c)).alias("fixed"), F.max(c).alias("oracle"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("chosen").alias("chosen"), F.sum("fixed").alias("fixed"), F.sum("oracle").alias("oracle"))


def resource_gate(df: DataFrame, by: Sequence[str], method: str, candidate: str, accuracy: str, size: str, seconds: str) -> DataFrame:
    """Whether the candidate beats the best other method by 2 points within 1.1 times its bytes and time, or matches it at 0.8 times either."""
    others = df.where(F.col(method) != candidate).groupBy(*by).agg(F.min_by(F.struct(accuracy, size, seconds, method), F.struct(-F.col(accuracy), F.col(size), F.col(method))).alias("b"))
    c = df.where(F.col(method) == candidate).select(*by, F.col(accuracy).alias("a"), F.col(size).alias("s"), F.col(seconds).alias("t")).join(others, list(by))
    better = (F.col("a") >= F.col(f"b.{accuracy}") + 2) & (F.col("s") <= 1.1 * F.col(f"b.{size}")) & (F.col("t") <= 1.1 * F.col(f"b.{seconds}"))
    cheaper = (F.col("a") >= F.col(f"b.{accuracy}")) & ((F.col("s") <= 0.8 * F.col(f"b.{size}")) | (F.col("t") <= 0.8 * F.col(f"b.{seconds}")))
    return c.select(*by, F.col(f"b.{method}").alias("baseline"), (better | cheaper).alias("passed"))


def gates(values: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each rule of a one-row table of metrics, and all of them."""
    every = F.lit(True)
    for r in rules.values():
        every = every & F.coalesce(r, F.lit(False))
    return values.select(*(F.coalesce(r, F.lit(False)).alias(k) for k, r in rules.items()), every.alias("passed"))


def annotations(labels: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label counts; an override goes before a label, neither is pending."""
    both = labels.join(overrides.withColumnRenamed("label", "_override"), list(keys), "left")
    return both.groupBy(F.coalesce("_override", "label", F.lit("pending")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("_override")).cast("double")).alias("agreement"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Mean of vectors by place, at length 1."""
    places = df.select(*keys, F.posexplode(vec).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_m"))
    n = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x["_m"] * x["_m"]))
    return places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_v")).select(*keys, F.transform("_v", lambda x: F.when(n > 0, x["_m"] / n).otherwise(0.0)).alias(vec))


def cost_closure(df: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str], slack: float = 1e-6) -> DataFrame:
    """Rows whose stage times don't add up to the total, by more than slack; unattributed time may be 1 s or 5 %."""
    rest = F.col(total) - sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return df.withColumn("unattributed", rest).where((rest < -slack) | (rest > F.greatest(F.lit(1.0), 0.05 * F.col(total)))).select(*keys, "unattributed")


def recovery(results: DataFrame, wanted: DataFrame, keys: Sequence[str], fingerprint: str, now: str) -> DataFrame:
    """State of each wanted key: completed, drifted (under another protocol) or open."""
    have = results.groupBy(*keys).agg(F.bool_or(F.col(fingerprint) == now).alias("_ok"))
    return wanted.select(*keys).distinct().join(have, list(keys), "left").select(*keys, F.when(F.col("_ok").isNull(), "open").when(F.col("_ok"), "completed").otherwise("drifted").alias("state"))


def retention(taken: DataFrame, top: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """By key the share of top rows that were taken, and over keys the unweighted mean."""
    hit = top.select(*keys, item).join(taken.select(*keys, item, F.lit(1).alias("_hit")).distinct(), [*keys, item], "left")
    each = hit.groupBy(*keys).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("retained"))
    macro = each.agg(F.avg("retained").alias("macro"))
    return each.join(F.broadcast(macro), F.lit(True))


def region_summary(cores: DataFrame, seeds: DataFrame, targets: DataFrame, keys: Sequence[str], time: str, score: str, item: str, low: str, high: str, bucket: int, least: int = 3) -> DataFrame:
    """Of each region: seeds, cores, edges (seeds beyond the first of a core), whether it is refined (a core of least seeds), whether its weight 1 + edges would say otherwise, whether it mixes
    such cores with others, its targets and those outside the windows of such cores, and its anchor (best seed): rank among all seeds, and whether it stands in the last twentieth of the time.

    cores: keys, core_id, region_id, seeds, left, right. seeds: keys, core_id, item, time, score, low, high. targets: keys, region_id, target, of refined regions.
    """
    by = [*keys, "region_id"]
    sums = cores.groupBy(*by).agg(F.sum("seeds").alias("m"), F.count(F.lit(1)).alias("c"), F.max("seeds").alias("_most"), F.min("seeds").alias("_few"))
    edges, refine = F.col("m") - F.col("c"), F.col("_most") >= least
    out = sums.select(*by, "m", "c", edges.alias("edges"), refine.alias("refine"), ((edges + 1 >= least) != refine).alias("weight_differs"), (refine & (F.col("_few") < least)).alias("mixed"))
    hot = merge_intervals(cores.where(F.col("seeds") >= least).select(*keys, "left", "right"), keys).groupBy(*keys, "region_id").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    cold = range_join(targets, hot.drop("region_id"), keys, "target", bucket, how="left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("cold_targets"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), time, item))
    placed = seeds.withColumn("_rank", rank).join(cores.select(*keys, "core_id", "region_id"), [*keys, "core_id"])
    best = placed.groupBy(*by).agg(F.min(F.struct("_rank", item, (20 * (F.col(time) - F.col(low)) >= 19 * (F.col(high) - F.col(low))).alias("late"))).alias("_a"))
    best = best.select(*by, F.col(f"_a.{item}").alias("anchor"), F.col("_a._rank").alias("anchor_rank"), F.col("_a.late").alias("late_anchor"))
    n = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("targets"))
    return out.join(best, by).join(n, by, "left").join(cold, by, "left").fillna(0, ["targets", "cold_targets"])


def selection_statistics(taken: DataFrame, segments: DataFrame, keys: Sequence[str], segment: str, item: str, score: str, similarity: Column) -> DataFrame:
    """Of each selection: segments, those covered, the share without a pick, mean score, and the mean over picks of the largest similarity to another pick of the segment (0 if there is none).

    similarity: of columns a and b, which hold the rows of two picks.
    """
    a, b = (taken.select(*keys, segment, F.struct(*taken.columns).alias(x)) for x in "ab")
    near = a.join(b, [*keys, segment]).where(F.col(f"a.{item}") != F.col(f"b.{item}")).groupBy(*keys, F.col(f"a.{item}").alias(item)).agg(F.max(similarity).alias("_near"))
    held = taken.join(near, [*keys, item], "left").groupBy(*keys).agg(F.count_distinct(segment).alias("covered"), F.avg(score).alias("relevance"), F.avg(F.coalesce("_near", F.lit(0.0))).alias("redundancy"))
    every = segments.groupBy(*keys).agg(F.count_distinct(segment).alias("segments"))
    return every.join(held, list(keys)).withColumn("unused", 1 - F.col("covered") / F.col("segments"))


def group_profile(df: DataFrame, sets: Sequence[Sequence[str]], methods: Sequence[str], cell: str, cells: Sequence[str], proxies: Sequence[str]) -> DataFrame:
    """By each grouping set, in one pass: n, right answers of each method and their share, rows of each cell, and mean and median of each proxy; columns outside a set are 'all'."""
    right = lambda m: F.count_if(F.coalesce(F.col(m), F.lit(False)))
    measures = {"n": F.count(F.lit(1))} | {f"right_{m}": right(m) for m in methods} | {f"rate_{m}": right(m) / F.count(F.lit(1)) for m in methods} | {f"cell_{c}": F.count_if(F.col(cell) == c) for c in cells}
    measures |= {f"mean_{p}": F.avg(p) for p in proxies} | {f"median_{p}": F.percentile(p, F.lit(0.5)) for p in proxies}
    return profile(df, sets, measures)


def path_states(top: DataFrame, prefixes: DataFrame, quotas: DataFrame, members: DataFrame, keys: Sequence[str], region: str, item: str) -> DataFrame:
    """How each top row fared under each method's quotas: keys, item, region, place (from 1 in its region's prefix), capacity, method, quota, state and more, the slots that it lacked.

    top: keys, item. prefixes: keys, region, item, place. quotas: keys, region, method, quota. members: keys, region, item, each item in one region. A region's capacity is what it could get if every other region kept one slot.
    States: selected, quota_reachable, beyond_capacity, outside_prefix.
    """
    size = prefixes.groupBy(*keys, region).agg(F.max("place").alias("_size"))
    of = Window.partitionBy(*keys, "method")
    room = quotas.withColumn("_room", F.sum("quota").over(of) - F.count(F.lit(1)).over(of) + 1).join(size, [*keys, region])
    met = top.select(*keys, item).join(members.select(*keys, region, item), [*keys, item]).join(prefixes.select(*keys, region, item, "place"), [*keys, region, item], "left").join(room, [*keys, region])
    capacity = F.least(F.col("_size"), F.col("_room"))
    state = F.when(F.col("place").isNull(), "outside_prefix").when(F.col("place") <= F.col("quota"), "selected").when(F.col("place") <= capacity, "quota_reachable").otherwise("beyond_capacity")
    return met.select(*keys, item, region, "place", capacity.alias("capacity"), "method", "quota", state.alias("state"), F.when(F.col("place").isNotNull(), F.greatest(F.col("place") - F.col("quota"), F.lit(0))).alias("more"))


def fine_summary(cores: DataFrame, fine: DataFrame, keys: Sequence[str], time: str, bucket: int, least: int = 3) -> DataFrame:
    """Of each region: its fine rows, those outside all windows of cores with least seeds or more, and how many of either are selected.

    cores: keys, region_id, seeds, left, right. fine: keys, time, selected; a row counts for the region in which it lies.
    """
    by = [*keys, "region_id"]
    spans = cores.groupBy(*by).agg(F.min("left").alias("left"), F.max("right").alias("right"))
    hot = merge_intervals(cores.where(F.col("seeds") >= least).select(*keys, "left", "right"), keys).groupBy(*keys, "region_id").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("region_id")
    met = range_join(fine, spans, keys, time, bucket).drop("left", "right")
    near = range_join(met, hot, keys, time, bucket, how="left_semi").withColumn("_hot", F.lit(1)).unionByName(range_join(met, hot, keys, time, bucket, how="left_anti").withColumn("_hot", F.lit(0)))
    n = near.groupBy(*by).agg(F.count(F.lit(1)).alias("fine"), F.count_if(F.col("_hot") == 0).alias("fine_outside"), F.count_if(F.col("selected")).alias("selected_fine"), F.count_if(F.col("selected") & (F.col("_hot") == 0)).alias("selected_outside"))
    return spans.select(*by).join(n, by, "left").fillna(0)


def direct_union(seeds: DataFrame, regions: DataFrame, keys: Sequence[str], time: str, radius: int) -> DataFrame:
    """keys and same: whether the regions (left, right) are just the union of the windows of single seeds (time, low, high), and widest, the largest step between seeds of a core (core_id), which says when they must be."""
    windows = seeds.select(*keys, F.greatest(F.col(time) - radius, F.col("low")).alias("left"), F.least(F.col(time) + radius, F.col("high")).alias("right"))
    union = merge_intervals(windows, keys).groupBy(*keys, "region_id").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    side = lambda df, n: df.select(*keys, "left", "right", F.lit(n).alias("_side"))
    each = side(union, 1).unionByName(side(regions, -1)).groupBy(*keys, "left", "right").agg(F.sum("_side").alias("_d"))
    same = each.groupBy(*keys).agg(F.bool_and(F.col("_d") == 0).alias("same"))
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys, "core_id").orderBy(time))
    return same.join(seeds.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.max("_step"), F.lit(0)).alias("widest")), list(keys), "left")
