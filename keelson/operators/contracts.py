"""Row contracts as frames of violations: an empty one means that the contract holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_unit


def violations(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule of each rule that isn't true of a row."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def candidate_violations(df: DataFrame, question: str, index: str = "candidate_index", time: str = "source_pts", score: str = "score", half_open: Column | None = None) -> DataFrame:
    """Candidates: indices 0 to n - 1 in time order, times that rise, scores within 0 and 1, and what half_open says of times."""
    w = Window.partitionBy(question).orderBy(time, index)
    rows = df.withColumn("_place", F.row_number().over(w) - 1).withColumn("_before", F.lag(time).over(w))
    rules = {"index": F.col(index) == F.col("_place"), "time_order": F.col("_before").isNull() | (F.col("_before") < F.col(time)), "score": (F.col(score) >= 0) & (F.col(score) <= 1) & ~F.isnan(score)}
    if half_open is not None:
        rules["time_range"] = half_open
    return violations(rows, [question, index], rules)


def feature_violations(df: DataFrame, keys: Sequence[str], vec: str, size: int) -> DataFrame:
    return violations(df, keys, {"size": F.size(vec) == size, "unit": is_unit(F.col(vec))})


def selection_violations(df: DataFrame, question: str, k: int, time: str = "source_pts", step: str = "step") -> DataFrame:
    """Selections: at most k rows, steps in time order, times once."""
    by = Window.partitionBy(question)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_place", F.row_number().over(by.orderBy(time, step))).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(question, time)))
    return violations(rows, [question, step], {"budget": F.col("_n") <= k, "order": F.col("_place") == F.col(step), "unique": F.col("_same") == 1})


def without_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """df without label columns, which selectors must not see."""
    return df.drop(*labels)


def unique_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which each side may hold one row; duplicates raise when the plan runs."""
    once = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a key occurs twice")).cast("boolean"))).drop("_n")
    return once(left).join(once(right), list(keys))


def population_faults(df: DataFrame, item: str, strata: dict[str, int], stratum: str, group: str, each: int, columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """kind, name, expected and found of what a frozen manifest isn't as it should be: items that occur twice (repeated), strata of another size, or not asked for (stratum), groups that don't hold each items (group_size),
    groups in more than one stratum (group_strata), and values that a column may not have (value). An empty one means that the manifest is the frozen one.
    """
    text = lambda c: F.col(c).cast("string")
    row = lambda kind, name, want, got: (F.lit(kind).alias("kind"), name.alias("name"), want.cast("long").alias("expected"), got.cast("long").alias("found"))
    twice = df.groupBy(text(item).alias("name")).count().where("count > 1").select(*row("repeated", F.col("name"), F.lit(1), F.col("count")))
    wanted = df.sparkSession.createDataFrame(list(strata.items()), "_s string, _want long")
    sizes = df.groupBy(text(stratum).alias("name")).count().join(wanted, F.col("name").eqNullSafe(F.col("_s")), "full")
    sizes = sizes.where(~F.coalesce("count", F.lit(0)).eqNullSafe(F.coalesce("_want", F.lit(0)))).select(*row("stratum", F.coalesce("name", "_s"), F.coalesce("_want", F.lit(0)), F.coalesce("count", F.lit(0))))
    groups = df.groupBy(text(group).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(stratum).alias("k"))
    out = twice.unionByName(sizes).unionByName(groups.where(F.col("n") != each).select(*row("group_size", F.col("name"), F.lit(each), F.col("n")))).unionByName(groups.where("k > 1").select(*row("group_strata", F.col("name"), F.lit(1), F.col("k"))))
    for c, allowed in (columns or {}).items():
        wrong = df.where(~F.coalesce(F.col(c).isin(*allowed), F.lit(False))).groupBy(F.concat_ws("=", F.lit(c), text(c)).alias("name")).count()
        out = out.unionByName(wrong.select(*row("value", F.col("name"), F.lit(0), F.col("count"))))
    return out
