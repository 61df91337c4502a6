"""Repairs of a selection by its neighbours in time, and regions of rows that show the same field, by windows over rows in time order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import range_join

TOLERANCE = 1e-8


def repair_decisions(pool: DataFrame, keys: Sequence[str], item: str, time: str, similarity: Callable[[Column, Column], Column], step: int) -> DataFrame:
    """keys, slot (from 0), item, reason, next_item (the selected row after it), new_item (its successor in time), score and gain of each selected row.

    pool: keys, item, time (no two alike in a key), coarse (it has a score), score, target (the grid target that it answers, or null), selected, protected, and what similarity compares: it takes two rows as structs.
    A selected row proposes to put its successor in place of the next selected row, unless: it is fine (no_score); it is the last (no_next_slot); a row beside it is selected (neighbour_selected); the next one is protected
    (next_protected); there is no successor (no_successor); either has no target (no_target); the successor's isn't the next one (not_next_target); the successor doesn't lie before the next slot (outside_slot); or it isn't
    more like the row than the next one is (no_gain). Otherwise it is eligible.
    """
    w = Window.partitionBy(*keys).orderBy(time, item)
    row = F.struct(*pool.columns)
    rows = pool.withColumns({"_before": F.lag("selected").over(w), "_after": F.lead(row).over(w)})
    taken = rows.where("selected").withColumns({"_next": F.lead(row).over(w), "slot": F.row_number().over(w) - 1, "_row": row})
    like = lambda other: F.least(F.greatest(_between(similarity, "_row", other), F.lit(0.0)), F.lit(1.0))
    gain = like("_after") - like("_next")
    reason = (
        F.when(~F.col("coarse"), "no_score")
        .when(F.col("_next").isNull(), "no_next_slot")
        .when(F.coalesce("_before", F.lit(False)) | F.coalesce(F.col("_after.selected"), F.lit(False)), "neighbour_selected")
        .when(F.col("_next.protected"), "next_protected")
        .when(F.col("_after").isNull(), "no_successor")
        .when(F.col("target").isNull() | F.col("_after.target").isNull(), "no_target")
        .when(F.col("_after.target") - F.col("target") != step, "not_next_target")
        .when(~((F.col(time) < F.col(f"_after.{time}")) & (F.col(f"_after.{time}") < F.col(f"_next.{time}"))), "outside_slot")
        .when(gain <= TOLERANCE, "no_gain")
        .otherwise("eligible")
    )
    return taken.select(*keys, "slot", item, time, reason.alias("reason"), F.col(f"_next.{item}").alias("next_item"), F.col(f"_after.{item}").alias("new_item"), F.col(f"_after.{time}").alias("new_time"), "score", gain.alias("gain"))


def _between(similarity: Callable[[Column, Column], Column], a: str, b: str) -> Column:
    """The similarity of two columns of rows, bound so that they are worked out once."""
    return F.get(F.transform(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))), lambda p: similarity(p["a"], p["b"])), F.lit(0))


def repaired(pool: DataFrame, keys: Sequence[str], item: str, time: str, decisions: DataFrame) -> DataFrame:
    """keys, item, time and origin (kept or added) of selections after at most one repair each: the eligible one of highest score, then of largest gain, then the earliest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("gain"), time, "new_time", item, "new_item")
    best = decisions.where("reason = 'eligible'").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    out = best.select(*keys, F.col("next_item").alias(item))
    kept = pool.where("selected").join(out, [*keys, item], "left_anti").select(*keys, item, time, F.lit("kept").alias("origin"))
    return kept.unionByName(best.select(*keys, F.col("new_item").alias(item), F.col("new_time").alias(time), F.lit("added").alias("origin")))


def field_regions(fields: DataFrame, frames: DataFrame, keys: Sequence[str], index: str, time: str, score: str, radius: int, low: str, high: str) -> DataFrame:
    """keys, field, first, last, representative, confidence, left, right, context, anchor and context_score of runs of consecutive frames that show one field.

    fields: keys, index, field, confidence; of a frame that shows a field more than once the surest counts. frames: keys, index, time, score, low and high (bounds of time), all frames. A run ends where a frame doesn't show the field. Its
    representative is its surest frame (the earlier of equals); its context are all frames within radius of it, and its anchor is the best of these by score (the earlier of equals).
    """
    seen = fields.groupBy(*keys, index, "field").agg(F.max("confidence").alias("confidence")).join(frames.select(*keys, index, time, low, high), [*keys, index])
    run = F.col(index) - F.row_number().over(Window.partitionBy(*keys, "field").orderBy(index))
    by = [*keys, "field", "_run"]
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col(time).alias("t"), F.col(index).alias("i"))).alias("_r")
    isles = seen.withColumn("_run", run).groupBy(*by).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.min(time).alias("_a"), F.max(time).alias("_b"), best, F.first(low).alias("_low"), F.first(high).alias("_high"))
    isles = isles.select(*by, "first", "last", F.col("_r.i").alias("representative"), (-F.col("_r.c")).alias("confidence"), F.greatest(F.col("_a") - radius, F.col("_low")).alias("left"), F.least(F.col("_b") + radius, F.col("_high")).alias("right"))
    spans = isles.select(*by, F.col("left").alias("_left"), F.col("right").alias("_right"))
    met = range_join(frames.select(*keys, index, time, score), spans, keys, time, 4 * radius, "_left", "_right")
    top = met.groupBy(*by).agg(F.count(F.lit(1)).alias("context"), F.min(F.struct((-F.col(score)).alias("s"), F.col(time).alias("t"), F.col(index).alias("i"))).alias("_t"))
    out = isles.join(top, by)
    return out.select(*keys, "field", "first", "last", "representative", "confidence", "left", "right", "context", F.col("_t.i").alias("anchor"), (-F.col("_t.s")).alias("context_score"))


def field_proposals(regions: DataFrame, frames: DataFrame, keys: Sequence[str], index: str, time: str) -> DataFrame:
    """keys, index, fields, context_score, confidence and rank of the frames that represent a region, each once with all of its regions: by context, then by confidence, then by time."""
    once = regions.groupBy(*keys, F.col("representative").alias(index)).agg(F.array_sort(F.collect_list("field")).alias("fields"), F.max("context_score").alias("context_score"), F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("context_score"), F.desc("confidence"), time, index))
    return once.join(frames.select(*keys, index, time), [*keys, index]).select(*keys, index, "fields", "context_score", "confidence", rank.alias("rank"))
