"""Sessions, interval merging, as-of and range joins, in integer ticks.

Times are whole numbers of ticks, so comparisons are exact. As-of joins sort a union of both sides by key and time instead of
comparing all pairs; range joins meet in buckets of time, so no side needs to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, ties: Sequence[str] = ()) -> DataFrame:
    """core_id from 0: a new one where the step from the row before is over gap."""
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    opens = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return df.withColumn("_open", F.coalesce(opens, F.lit(0))).withColumn("core_id", F.sum("_open").over(w)).drop("_open")


def core_windows(cores: DataFrame, keys: Sequence[str], time: str, radius: int, low: Column, high: Column) -> DataFrame:
    """left, right and seeds of each core, widened by radius within low and high (aggregates of the group)."""
    return cores.groupBy(*keys, "core_id").agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.count(F.lit(1)).alias("seeds"), low.alias("_low"), high.alias("_high")).select(
        *keys, "core_id", "seeds", F.greatest(F.col("_a") - radius, F.col("_low")).alias("left"), F.least(F.col("_b") + radius, F.col("_high")).alias("right")
    )


def merge_intervals(df: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right") -> DataFrame:
    """region_id from 0 of closed intervals; those that touch are one."""
    w = Window.partitionBy(*keys).orderBy(left, right)
    before = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", (F.col(left) > before).cast("int")).withColumn("region_id", F.sum(F.coalesce("_new", F.lit(0))).over(w)).drop("_new")


def regions(cores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged windows of cores (left, right, seeds): m seeds, c cores, weight 1 + m - c, and whether a core has 3 seeds or more."""
    return merge_intervals(cores, keys).groupBy(*keys, "region_id").agg(
        F.min("left").alias("left"), F.max("right").alias("right"), F.sum("seeds").alias("m"), F.count(F.lit(1)).alias("c"), (F.lit(1) + F.sum("seeds") - F.count(F.lit(1))).alias("weight"), (F.max("seeds") >= 3).alias("refine")
    )


def conditional_groups(cores: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """keys, core_id, group_id (its smallest core) and weight of cores (left, right, seeds): only windows of least seeds or more are merged where they touch, and no sparser one joins them or others."""
    hot = merge_intervals(cores.where(F.col("seeds") >= least), keys).select(*keys, "core_id", "seeds", F.min("core_id").over(Window.partitionBy(*keys, "region_id")).alias("group_id"))
    every = hot.unionByName(cores.where(F.col("seeds") < least).select(*keys, "core_id", "seeds", F.col("core_id").alias("group_id")))
    return every.select(*keys, "core_id", "group_id", (F.lit(1) + F.sum(F.col("seeds") - 1).over(Window.partitionBy(*keys, "group_id"))).cast("double").alias("weight"))


def voronoi_cells(df: DataFrame, keys: Sequence[str], tick: int, low: Column, high: Column, left: str = "left", right: str = "right") -> DataFrame:
    """cell_left and cell_right of disjoint regions: cut at the middle of a gap, on the tick at or before it; ends at low and high."""
    w = Window.partitionBy(*keys).orderBy(left)
    cut = lambda a, b: F.floor(F.floor((a + b) / 2) / tick) * tick
    before, after = F.lag(right).over(w), F.lead(left).over(w)
    return df.withColumn("cell_left", F.when(before.isNull(), low).otherwise(cut(before, F.col(left)) + tick)).withColumn("cell_right", F.when(after.isNull(), high).otherwise(cut(F.col(right), after)))


def grid_asof(df: DataFrame, keys: Sequence[str], time: str, start: Column, phase: int, step: int, ties: Sequence[str] = ()) -> DataFrame:
    """Rows that answer targets start + phase + k * step, with target_index k: a row at or after the earliest target still open answers it, and the next one open is the first after the row.

    No join and no state: a row answers if no earlier one stands at or after the last target that it has reached, and its target follows the last one that the row before had reached.
    """
    reached = F.greatest(F.floor((F.col(time) - start - phase) / step), F.lit(-1))
    before = F.coalesce(F.lag("_reached").over(Window.partitionBy(*keys).orderBy(time, *ties)), F.lit(-1))
    return df.withColumn("_reached", reached).withColumn("target_index", before + 1).where(F.col("_reached") >= F.col("target_index")).drop("_reached")


def backward_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: Sequence[str]) -> DataFrame:
    """left with value columns of the last right row at or before its time, one sort of the union."""
    pad = lambda df, side: df.select(*keys, time, F.lit(side).alias("_side"), *(F.col(c) if side == 0 else F.lit(None).alias(c) for c in value), *((F.lit(None).alias(c) if side == 0 else F.col(c)) for c in left.columns if c not in (*keys, time)))
    types = dict(left.dtypes) | dict(right.dtypes)
    both = [x.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in x.columns)) for x in (pad(right, 0), pad(left, 1))]
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both[0].unionByName(both[1])
    last = F.last(F.when(F.col("_side") == 0, F.struct(*value)), ignorenulls=True).over(w)
    return filled.withColumn("_last", last).where("_side = 1").select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in value))


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, bucket: int, left: str = "left", right: str = "right", how: str = "inner") -> DataFrame:
    """points within closed spans of their key: spans are put in each bucket of time that they touch, points in one."""
    p = points.withColumn("_bucket", F.floor(F.col(time) / bucket))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(left) / bucket), F.floor(F.col(right) / bucket))))
    on = (p["_bucket"] == s["_bucket"]) & (p[time] >= s[left]) & (p[time] <= s[right])
    for k in keys:
        on &= p[k] == s[k]
    out = p.join(s, on, how)
    return out.select(*points.columns) if how in ("left_semi", "left_anti") else out.select(*(p[c] for c in points.columns), *(s[c] for c in spans.columns if c not in keys))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int, a_id: str, b_id: str) -> DataFrame:
    """Overlapping closed intervals (left, right) of both sides, with overlap, degrees and the kind of match. A pair is made in the first bucket that it shares."""
    spread = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("left") / bucket), F.floor(F.col("right") / bucket))))
    x = spread(a.select(*keys, a_id, "left", "right")).withColumnsRenamed({"left": "_al", "right": "_ar"})
    y = spread(b.select(*keys, b_id, "left", "right")).withColumnsRenamed({"left": "_bl", "right": "_br"})
    met = x.join(y, [*keys, "_bucket"]).where((F.greatest("_al", "_bl") <= F.least("_ar", "_br")) & (F.floor(F.greatest("_al", "_bl") / bucket) == F.col("_bucket")))
    pairs = met.select(*keys, a_id, b_id, (F.least("_ar", "_br") - F.greatest("_al", "_bl")).alias("overlap"))
    pairs = pairs.withColumn("a_degree", F.count(F.lit(1)).over(Window.partitionBy(*keys, a_id))).withColumn("b_degree", F.count(F.lit(1)).over(Window.partitionBy(*keys, b_id)))
    one_a, one_b = F.col("a_degree") == 1, F.col("b_degree") == 1
    return pairs.withColumn("kind", F.when(one_a & one_b, "one_to_one").when(one_b, "split").when(one_a, "merge").otherwise("many_to_many"))


def nearest_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, point_id: Sequence[str], span_id: str) -> DataFrame:
    """The interval nearest to each point (distance 0 inside), ties to the earlier start. Intervals of a key are disjoint, so only the last that starts at or before a point and the first after it count: one sort, no pairs."""
    kinds = dict(points.dtypes) | dict(spans.dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    ids = [c for c in point_id if c != time]
    p = points.select(*keys, F.col(time).alias("_t"), *ids, none(span_id), F.lit(None).cast(kinds["left"]).alias("left"), F.lit(None).cast(kinds["right"]).alias("right"), F.lit(1).alias("_point"))
    s = spans.select(*keys, F.col("left").alias("_t"), *(none(c) for c in ids), span_id, "left", "right", F.lit(0).alias("_point"))
    order = Window.partitionBy(*keys).orderBy("_t", "_point")
    span = F.when(F.col("_point") == 0, F.struct("left", "right", span_id))
    met = p.unionByName(s).withColumns({"_b": F.last(span, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first(span, True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("_point = 1")
    before, after = F.greatest(F.col("_t") - F.col("_b.right"), F.lit(0)), F.col("_a.left") - F.col("_t")
    first = F.col("_a").isNull() | (before <= after)
    near = F.when(F.col("_b").isNotNull() & first, F.struct(F.col(f"_b.{span_id}").alias(span_id), before.alias("distance"))).when(F.col("_a").isNotNull(), F.struct(F.col(f"_a.{span_id}").alias(span_id), after.alias("distance")))
    out = met.withColumn("_n", near).where("_n IS NOT NULL")
    return out.select(*keys, *(F.col("_t").alias(c) if c == time else F.col(c) for c in point_id), F.col(f"_n.{span_id}").alias(span_id), F.col("_n.distance").alias("distance"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, item: str) -> DataFrame:
    """Distance from each left row to the nearest right row in time, from the last one before and the first one after, by one sort."""
    both = left.select(*keys, time, item, F.lit(1).alias("_side")).unionByName(right.select(*keys, time, F.lit(None).cast(dict(left.dtypes)[item]).alias(item), F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy(time)
    mark = F.when(F.col("_side") == 0, F.col(time))
    before = F.last(mark, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    return both.withColumn("_b", before).withColumn("_a", after).where("_side = 1").select(*keys, time, item, F.least(F.col(time) - F.col("_b"), F.col("_a") - F.col(time)).alias("distance"))


def gap_weight(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, point_id: Sequence[str], region: str) -> DataFrame:
    """Weight of points to their regions: 1 inside and outside all, linear from 1 at a region's edge to 1/2 at the middle of a gap.

    A point in a gap belongs to the nearer side.
    """
    near = nearest_interval(points, spans, keys, time, point_id, region)
    w = Window.partitionBy(*keys).orderBy("left")
    gaps = spans.withColumn("_before", F.lag("right").over(w)).withColumn("_after", F.lead("left").over(w)).select(*keys, region, "left", "right", "_before", "_after")
    rows = points.select(*keys, *point_id, *([time] if time not in point_id else [])).join(near, [*keys, *point_id]).join(gaps, [*keys, region])
    gap = F.when(F.col(time) < F.col("left"), F.col("left") - F.col("_before")).when(F.col(time) > F.col("right"), F.col("_after") - F.col("right"))
    return rows.select(*keys, *point_id, region, F.coalesce(F.when(gap > 0, 1 - F.col("distance") / gap), F.lit(1.0)).alias("weight"))


def decay_support(df: DataFrame, keys: Sequence[str], time: str, score: str, scale: float) -> DataFrame:
    """support: max over rows of score * exp(-|dt| / scale). The maximum factors over either side of a row, so running maxima of score * exp(+-t / scale) give it without pairs; logarithms keep them in range."""
    w = Window.partitionBy(*keys).orderBy(time)
    log = F.when(F.col(score) > 0, F.ln(score))
    up = F.max(log + F.col(time) / scale).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(time) / scale
    down = F.max(log - F.col(time) / scale).over(w.rowsBetween(0, Window.unboundedFollowing)) + F.col(time) / scale
    return df.withColumn("support", F.coalesce(F.exp(F.greatest(up, down)), F.lit(0.0)))


def field_islands(df: DataFrame, keys: Sequence[str], field: str, index: str) -> DataFrame:
    """Runs of consecutive indices that share a field: island (first index), size."""
    at = Window.partitionBy(*keys, field).orderBy(index)
    runs = df.withColumn("_run", F.col(index) - F.row_number().over(at))
    return runs.groupBy(*keys, field, "_run").agg(F.min(index).alias("island"), F.max(index).alias("island_end"), F.count(F.lit(1)).alias("size")).drop("_run")


def refinement_targets(spans: DataFrame, keys: Sequence[str], step: int, phase: int, skip_step: int | None = None) -> DataFrame:
    """Grid targets k * step + phase within closed spans, without those of a coarser grid of skip_step."""
    first, last = F.ceil((F.col("left") - phase) / step), F.floor((F.col("right") - phase) / step)
    out = spans.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("target", F.col("_k") * step + phase).drop("_k")
    return out if skip_step is None else out.where(F.pmod("target", F.lit(skip_step)) != 0)


def neighbour_repairs(df: DataFrame, keys: Sequence[str], time: str, selected: str, step: int) -> DataFrame:
    """For each selected row: its successor in time, the next selected one, and why the successor is or isn't proposed."""
    w = Window.partitionBy(*keys).orderBy(time)
    after = Window.partitionBy(*keys).orderBy(time).rowsBetween(1, Window.unboundedFollowing)
    rows = df.withColumn("next_time", F.lead(time).over(w)).withColumn("next_taken", F.lead(selected).over(w)).withColumn("before_taken", F.lag(selected).over(w)).withColumn("slot_time", F.min(F.when(F.col(selected), F.col(time))).over(after))
    reason = (
        F.when(F.col("next_time").isNull(), "no_successor").when(F.col("slot_time").isNull(), "no_next_slot").when(F.col("next_taken"), "successor_selected").when(F.coalesce("before_taken", F.lit(False)), "predecessor_selected").when(F.col("next_time") - F.col(time) > step, "too_far").otherwise("proposed")
    )
    return rows.where(selected).withColumn("reason", reason)


def by_key_frame(requests: DataFrame, key_frames: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """keys, key_time, n, first, last and times of requested times that share the last key frame at or before them, so that one seek serves them; key_time is null for times before the first one. A time asked for twice counts once."""
    asked = requests.select(*keys, time).distinct()
    met = backward_asof(asked, key_frames.select(*keys, time, F.col(time).alias("key_time")).distinct(), keys, time, ["key_time"])
    return met.groupBy(*keys, "key_time").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.array_sort(F.collect_list(time)).alias("times"))


def inside_windows(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, bucket: int, region: str, quotas: DataFrame) -> DataFrame:
    """points in a window of a region (disjoint; keys, region, left, right), with the region; one that holds fewer points than its quota (keys, region, quota) is an error when this runs."""
    met = range_join(points, spans.select(*keys, region, "left", "right"), keys, time, bucket).drop("left", "right")
    room = spans.select(*keys, region).distinct().join(quotas, [*keys, region]).join(met.groupBy(*keys, region).agg(F.count(F.lit(1)).alias("_n")), [*keys, region], "left")
    short = F.coalesce("_n", F.lit(0)) < F.col("quota")
    fits = room.select(*keys, region, F.when(short, F.raise_error(F.concat(F.lit("too few rows for the quota of region "), F.col(region).cast("string"))).cast("boolean")).otherwise(True).alias("_fits"))
    return met.join(fits, [*keys, region], "left").where(F.coalesce("_fits", F.lit(True))).drop("_fits")
