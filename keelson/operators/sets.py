"""Set operations with identity by time and index, completeness checks and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """common, union and jaccard of the items of both sides by key, one aggregation over their union."""
    both = a.select(*keys, *item, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, *item, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = both.groupBy(*keys, *item).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return each.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("common"), F.count(F.lit(1)).alias("union")).withColumn("jaccard", F.col("common") / F.col("union"))


def added_removed(old: DataFrame, new: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Items that only one side has, with change added or removed."""
    both = old.select(*keys, *item, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(*keys, *item, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    each = both.groupBy(*keys, *item).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n")).where("_o <> _n")
    return each.select(*keys, *item, F.when(F.col("_n") == 1, "added").otherwise("removed").alias("change"))


def first_wins(df: DataFrame, identity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each identity."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(*order))).where("_n = 1").drop("_n")


def mass_union(a: DataFrame, b: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Union of two sets, each of mass 1 by key, with mass and centre (mass before plus half of its own) in item order."""
    by = Window.partitionBy(*keys)
    weigh = lambda df, k: df.select(*keys, *item, (F.lit(0.5) / F.count(F.lit(1)).over(by)).alias(k))
    rows = weigh(a, "_x").join(weigh(b, "_y"), [*keys, *item], "full_outer").withColumn("mass", F.coalesce("_x", F.lit(0.0)) + F.coalesce("_y", F.lit(0.0))).drop("_x", "_y")
    return rows.withColumn("centre", F.sum("mass").over(by.orderBy(*item).rowsBetween(Window.unboundedPreceding, 0)) - F.col("mass") / 2)


def disjoint_union(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows of both with their source and whether their key is in both (conflict)."""
    rows = a.withColumn("source", F.lit(names[0])).unionByName(b.withColumn("source", F.lit(names[1])))
    both = F.min("source").over(Window.partitionBy(*keys)) != F.max("source").over(Window.partitionBy(*keys))
    return rows.withColumn("conflict", both)


def incomplete(have: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from have, or not wanted."""
    return added_removed(want, have, [], keys).withColumn("problem", F.when(F.col("change") == "added", "unexpected").otherwise("missing")).drop("change")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], discrete: Sequence[str] = (), numeric: Sequence[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """Fields that differ between two results: equal for discrete ones, within tolerance for numbers; missing rows are differences."""
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in (*discrete, *numeric)), F.lit(True).alias("_old"))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in (*discrete, *numeric)), F.lit(True).alias("_new"))
    both = o.join(n, list(keys), "full_outer")
    found = [F.when(F.col("_old").isNull() | F.col("_new").isNull(), "row")]
    found += [F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), c) for c in discrete]
    found += [F.when(~((F.abs(F.col(f"_o_{c}") - F.col(f"_n_{c}")) <= tolerance) | (F.col(f"_o_{c}").isNull() & F.col(f"_n_{c}").isNull())).eqNullSafe(F.lit(True)), c) for c in numeric]
    missing = F.col("_old").isNull() | F.col("_new").isNull()
    fields = F.when(missing, F.array(F.lit("row"))).otherwise(F.array_compact(F.array(*found)))
    return both.select(*keys, F.explode(fields).alias("field"))


def canonical(df: DataFrame, content: str, name: str) -> DataFrame:
    """Each name with the smallest one of its content."""
    return df.withColumn("canonical", F.min(name).over(Window.partitionBy(content)))


def resolve_alias(df: DataFrame, aliases: DataFrame, label: str, scope: str) -> DataFrame:
    """id of a label in its scope or the global one, without regard to case; null and ambiguous where there are several."""
    a = aliases.select(F.lower("label").alias("_label"), F.col("scope").alias("_scope"), "id")
    met = df.join(a, (F.lower(F.col(label)) == a["_label"]) & ((a["_scope"] == df[scope]) | (a["_scope"] == "global")), "left")
    one = met.groupBy(*df.columns).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id"))
    return one.select(*df.columns, F.when(F.col("_n") == 1, F.col("id")).alias("id"), (F.col("_n") > 1).alias("ambiguous"))


def shared_inputs(df: DataFrame, question: str, digest: str, method: str, priority: Sequence[str]) -> DataFrame:
    """Methods of a question with one input: the representative (first by priority) and all."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(method))
    rank = F.when(place > 0, place).otherwise(len(priority) + 1)
    return df.groupBy(question, digest).agg(F.min_by(method, F.struct(rank, F.col(method))).alias("representative"), F.array_sort(F.collect_set(method)).alias("methods"))


def query_seed_weights(df: DataFrame, region: Sequence[str], query: str, item: str, score: str) -> DataFrame:
    """Weight of each seed of a region over several queries: scores over the best of their query in the region, the largest over queries; 1 for all seeds where no query scores."""
    peak = F.max(score).over(Window.partitionBy(*region, query))
    share = df.withColumn("_share", F.when(peak > 0, F.col(score) / peak).otherwise(0.0))
    each = share.groupBy(*region, item).agg(F.max("_share").alias("weight"))
    top = F.max("weight").over(Window.partitionBy(*region))
    return each.withColumn("weight", F.when(top > 0, F.col("weight")).otherwise(1.0))


def lookup_bank(known: DataFrame, identity: Sequence[str], value: str) -> DataFrame:
    """identity and value of each identity once; one with two values is an error when this runs."""
    one = known.groupBy(*identity).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return one.where(F.when(F.col("_a").eqNullSafe(F.col("_b")), True).otherwise(F.raise_error(F.lit("an identity has two values")).cast("boolean"))).select(*identity, F.col("_a").alias(value))


def looked_up(wanted: DataFrame, bank: DataFrame, groups: Sequence[str], identity: Sequence[str], value: str) -> DataFrame:
    """wanted with the bank's value for the groups of which every row has one; the rows of all others have null, and are to be worked out as a whole."""
    met = wanted.join(bank.select(*identity, F.col(value).alias(value), F.lit(True).alias("_has")), list(identity), "left")
    whole = F.bool_and(F.coalesce("_has", F.lit(False))).over(Window.partitionBy(*groups))
    return met.select(*wanted.columns, F.when(whole, F.col(value)).alias(value), whole.alias("complete"))
