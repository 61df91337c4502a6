"""Texts at places of pictures: boxes from polygons, overlaps by a grid, changes of layout, and selections that they discount.

A frame's regions are rows (frame, region, text, x1, y1, x2, y2 within 0 and 1). Which frames are compared is a table of pairs; boxes meet only in grid cells that both touch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_change
from ..sources.shared import shuffled
from . import matching

SIDES = ("x1", "y1", "x2", "y2")


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


def plain_text(text: Column) -> Column:
    """NFC, case folded, runs of whitespace as one space; ASCII, which is nearly all, stays in the JVM."""
    straight = F.replace(text, F.lit("’"), F.lit("'"))
    ascii_ = F.octet_length(straight) == F.char_length(straight)
    return F.when(ascii_, F.trim(F.regexp_replace(F.lower(straight), r"[\s\x1c-\x1f]+", " "))).otherwise(F.pandas_udf(_composed, "string")(straight))


def boxes(regions: DataFrame, least: float = 0.5) -> DataFrame:
    """frame, region, text and box of read regions (frame, region, text, score, polygon array<array<double>> of four points, width, height).

    Regions below the least score, or without a text, are left out. A score beyond 0 and 1, or a polygon that isn't four finite points with an area inside the picture, is an error.
    """
    at = lambda i: F.transform("polygon", lambda p: p[i])
    low = [F.array_min(at(i)) for i in (0, 1)]
    high = [F.array_max(at(i)) for i in (0, 1)]
    sound = lambda x: F.coalesce(x, F.lit(False))
    shape = (F.size("polygon") == 4) & F.forall("polygon", lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    inside = (low[0] >= 0) & (low[1] >= 0) & (high[0] <= F.col("width")) & (high[1] <= F.col("height")) & (low[0] < high[0]) & (low[1] < high[1])
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.lit(" in frame "), F.col("frame").cast("string"))).cast("string")
    text = F.when(~sound((F.col("score") >= 0) & (F.col("score") <= 1)), fail("a score beyond 0 and 1")).when(F.col("score") < least, F.lit("")).otherwise(plain_text(F.coalesce("text", F.lit(""))))
    kept = regions.withColumn("text", text).where("text <> ''")
    kept = kept.withColumn("text", F.when(sound(shape & inside), F.col("text")).otherwise(fail("not a box inside the picture")))
    return kept.select("frame", "region", "text", *((v / F.col(n)).alias(c) for c, v, n in zip(SIDES, (*low, *high), ("width", "height", "width", "height"), strict=True)))


def intersection_over_union(a: Sequence[Column], b: Sequence[Column]) -> Column:
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return both / (area(a) + area(b) - both)


def overlapping(pairs: DataFrame, placed: DataFrame, grid: int = 8) -> DataFrame:
    """left, right, a, b, iou, a_text, b_text of regions a of frame left and b of frame right whose boxes overlap. Each pair is made in the cell where its overlap begins."""
    cell = lambda c: F.least(F.floor(F.col(c) * grid), F.lit(grid - 1)).cast("int")
    spread = placed.withColumn("cx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("cy", F.explode(F.sequence(cell("y1"), cell("y2"))))

    def side(frame: str, name: str) -> DataFrame:
        return spread.select(F.col("frame").alias(frame), F.col("region").alias(name), F.col("text").alias(f"{name}_text"), *(F.col(c).alias(f"{name}_{c}") for c in SIDES), "cx", "cy")

    met = pairs.select("left", "right").distinct().join(shuffled(side("left", "a")), "left").join(shuffled(side("right", "b")), ["right", "cx", "cy"])
    begin = lambda c: F.least(F.floor(F.greatest(f"a_{c}", f"b_{c}") * grid), F.lit(grid - 1))
    iou = intersection_over_union([F.col(f"a_{c}") for c in SIDES], [F.col(f"b_{c}") for c in SIDES])
    return met.where((begin("x1") == F.col("cx")) & (begin("y1") == F.col("cy"))).withColumn("iou", iou).where("iou > 0").select("left", "right", "a", "b", "iou", "a_text", "b_text")


def layout_changes(pairs: DataFrame, placed: DataFrame, grid: int = 8) -> DataFrame:
    """left, right and change: over boxes that are each other's only best overlap, the largest overlap times edit change of their texts; 0 where there are none."""
    met = overlapping(pairs, placed, grid)
    best = matching.mutual_best(met, ["left", "right"], "a", "b", "iou")
    told = best.join(shuffled(met.drop("iou")), ["left", "right", "a", "b"]).groupBy("left", "right").agg(F.max(F.col("iou") * edit_change(F.col("a_text"), F.col("b_text"))).alias("change"))
    return pairs.select("left", "right").distinct().join(shuffled(told), ["left", "right"], "left").select("left", "right", F.coalesce("change", F.lit(0.0)).alias("change"))


def spatial_prefix(items: DataFrame, similar: Callable[[DataFrame], DataFrame], placed: DataFrame, saved: Callable[[DataFrame, int], DataFrame], budget: int, grid: int = 8) -> DataFrame:
    """region, item, step (0 for the anchor): a greedy order of each region's items by support * sqrt(1 - redundancy), where redundancy is the largest cosine to a chosen item, less what their layouts differ.

    items: region, item (also the frame of its texts), time, support, anchor (boolean, one a region). similar gives the cosine of pairs (left, right) as a column c. All regions take a step together; what is
    paired in a step is the item chosen last with the region's others. Ties go to the earlier time, then the smaller item. saved writes a state and reads it again, so a step's plan holds one step.
    """
    start = items.select("region", "item", "time", "support", "anchor", F.when(F.col("anchor"), 0).alias("step"), F.lit(0.0).alias("redundancy"))
    state, last = saved(start, 0), items.where("anchor").select("region", F.col("item").alias("right"))
    for step in range(1, budget):
        pairs = state.select("region", F.col("item").alias("left")).join(shuffled(last), "region").select("left", "right")
        worth = similar(pairs).join(shuffled(layout_changes(pairs, placed, grid)), ["left", "right"])
        fresh = worth.select(F.col("left").alias("item"), (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))) * (1 - F.col("change"))).alias("new"))
        state = state.join(shuffled(fresh), "item", "left").withColumn("redundancy", F.greatest("redundancy", F.coalesce("new", F.lit(0.0)))).drop("new")
        score = F.when(F.col("step").isNull(), F.col("support") * F.sqrt(1 - F.col("redundancy")))
        place = F.row_number().over(Window.partitionBy("region").orderBy(score.desc_nulls_last(), "time", "item"))
        state = state.withColumn("step", F.when(F.col("step").isNull() & (place == 1), step).otherwise(F.col("step")))
        state = saved(state, step)
        last = state.where(F.col("step") == step).select("region", F.col("item").alias("right"))
    return state.where("step IS NOT NULL").select("region", "item", "step")
