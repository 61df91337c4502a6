"""Candidate pools: masks, re-indexing, refinement and prefix cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import gap_sessions, range_join


def exclude(df: DataFrame, gone: DataFrame, keys: Sequence[str], index: str = "candidate_index", order: Sequence[str] = ("source_pts",)) -> DataFrame:
    """Rows not in gone, numbered anew from 0; the old number stays as original_index."""
    left = df.join(gone.select(*keys, index), [*keys, index], "left_anti").withColumnRenamed(index, "original_index")
    return left.withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "original_index")) - 1)


def usable(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that aren't constant: their least and greatest value differ."""
    return df.where(F.col(low) != F.col(high))


def masked_questions(df: DataFrame, options: str, bad) -> DataFrame:
    """df with excluded: whether any option is bad (null counts as bad). Folds are assigned before."""
    return df.withColumn("excluded", F.exists(options, lambda o: F.coalesce(bad(o), F.lit(True))))


def fine_pool(coarse: DataFrame, targets: DataFrame, frames: DataFrame, keys: Sequence[str], time: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fine rows to add, and the status of each target: added, duplicate_source, outside_window, no_source.

    targets: keys, target, right (end of the window). A target takes the first frame at or after it; frames that the coarse pool
    has, or that an earlier target took, are duplicates. The first frame after a target comes from one sort of both.
    """
    t = targets.select(*keys, F.col("target").alias(time), "right", F.lit(0).alias("_frame"))
    f = frames.select(*keys, time, F.lit(None).cast(dict(targets.dtypes)["right"]).alias("right"), F.lit(1).alias("_frame"))
    w = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_frame")).rowsBetween(0, Window.unboundedFollowing)
    met = t.unionByName(f).withColumn("source", F.first(F.when(F.col("_frame") == 1, F.col(time)), ignorenulls=True).over(w)).where("_frame = 0").select(*keys, F.col(time).alias("target"), "right", "source")
    have = coarse.select(*keys, F.col(time).alias("source"), F.lit(True).alias("_have")).distinct()
    rows = met.join(have, [*keys, "source"], "left").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "source").orderBy("target")))
    status = F.when(F.col("source").isNull(), "no_source").when(F.col("source") > F.col("right"), "outside_window").when(F.col("_have") | (F.col("_nth") > 1), "duplicate_source").otherwise("added")
    rows = rows.withColumn("status", status)
    if cap is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "status").orderBy("target"))).withColumn("status", F.when((F.col("status") == "added") & (F.col("_k") > cap), "over_cap").otherwise(F.col("status")))
    return rows.where("status = 'added'").select(*keys, F.col("source").alias(time)), rows.select(*keys, "target", "source", "status")


def appended(coarse: DataFrame, fine: DataFrame, keys: Sequence[str], time: str, index: str = "candidate_index") -> DataFrame:
    """Coarse rows with their indices, then fine rows numbered on in time order, with origin."""
    last = coarse.groupBy(*keys).agg(F.max(index).alias("_last"))
    more = fine.join(last, list(keys), "left").withColumn(index, F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy(*keys).orderBy(time))).select(*keys, index, time)
    return coarse.select(*keys, index, time, F.lit("coarse").alias("origin")).unionByName(more.select(*keys, F.col(index).cast(dict(coarse.dtypes)[index]).alias(index), time, F.lit("fine").alias("origin")))


def cut_prefixes(prefixes: DataFrame, quotas: DataFrame, keys: Sequence[str], step: str = "step", quota: str = "quota") -> DataFrame:
    """The first quota rows of each prefix."""
    return prefixes.join(quotas, list(keys)).where(F.col(step) <= F.col(quota))


def feasible_quotas(df: DataFrame, keys: Sequence[str], budget: Column, size: str, want: str) -> DataFrame:
    """Quotas filled in order: each region gets what it wants, at most its size and what is left after one for each later region."""
    items = F.array_sort(F.collect_list(F.struct("region_id", F.col(size).alias("size"), F.col(want).alias("want"))))
    rows = df.groupBy(*keys).agg(items.alias("_r"), F.first(budget).alias("_b"))
    start = F.struct(F.col("_b").cast("long").alias("left"), F.size("_r").cast("long").alias("open"), F.array().cast("array<struct<region_id:long,quota:long>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        q = F.greatest(F.lit(0).cast("long"), F.least(x["want"].cast("long"), x["size"].cast("long"), s["left"] - (s["open"] - 1)))
        return F.struct((s["left"] - q).alias("left"), (s["open"] - 1).alias("open"), F.concat(s["out"], F.array(F.struct(x["region_id"].cast("long").alias("region_id"), q.alias("quota")))).alias("out"))

    return rows.select(*keys, F.explode(F.aggregate("_r", start, step)["out"]).alias("_q")).select(*keys, "_q.*")


#: statuses of repooled targets: no frame in the frozen pool, frame beyond the new window, frame held already, frame taken
SCOPED = ("parent_unavailable", "outside_new_scope", "duplicate_source", "retained")
RETARGETED = ("frozen_no_source", "outside_new_window", "duplicate_source", "reused")


def repooled(bank: DataFrame, windows: DataFrame, coarse: DataFrame, keys: Sequence[str], time: str, bucket: int, names: Sequence[str] = SCOPED) -> DataFrame:
    """What new windows (left, right; disjoint) keep of a frozen fine pool: keys, target, source, status, for the targets that stand in a window.

    bank: keys, target, source, status, as fine_pool gives them. A frame is taken once, by its first target, and never if the coarse pool has it. Nothing is
    looked up anew: where the frozen pool found no frame within its window, the target stays without.
    """
    none, outside, twice, kept = names
    met = range_join(bank, windows.select(*keys, "left", "right"), keys, "target", bucket)
    have = coarse.select(*keys, F.col(time).alias("source"), F.lit(True).alias("_have")).distinct()
    known = F.col("status").isin("added", "duplicate_source")
    fits = known & F.col("source").between(F.col("left"), F.col("right"))
    rows = met.join(have, [*keys, "source"], "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*keys, "source", "_fits").orderBy("target"))
    status = F.when(~known, none).when(~F.col("_fits"), outside).when(F.col("_have") | (nth > 1), twice).otherwise(kept)
    return rows.select(*keys, "target", "source", status.alias("status"))


def seed_plan(pool: DataFrame, seeds: DataFrame, keys: Sequence[str], item: str, time: str, score: str, gap: int) -> DataFrame:
    """keys, core_id, seeds, first, last, anchor and peak of the cores of seeds that any routes have chosen under one budget: where they lie makes the cores, and the pool's own score their anchor (the best, the earlier of equals)."""
    own = pool.select(*keys, item, time, score).join(seeds.select(*keys, item).distinct(), [*keys, item])
    cores = gap_sessions(own, keys, time, gap, [item])
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(time).alias("t"), F.col(item).alias("i"))).alias("_b")
    out = cores.groupBy(*keys, "core_id").agg(F.count(F.lit(1)).alias("seeds"), F.min(time).alias("first"), F.max(time).alias("last"), best)
    return out.select(*keys, "core_id", "seeds", "first", "last", F.col("_b.i").alias("anchor"), (-F.col("_b.s")).alias("peak"))
