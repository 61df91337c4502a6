"""Replays of recorded competitions, and selections that are checked until nothing chosen is unfit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("support", "redundancy", "score")


def competition(trace: DataFrame, items: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """region, step, item, support, redundancy, score and chosen of every item that still stood at each step, the winner among them.

    trace: region, step (0 for the anchor, which wins unopposed), item. items: region, item, support. similar gives the clipped cosine c of pairs (left, right). Redundancy is the largest cosine to an item that was
    chosen before: a running maximum over steps, so an item meets each chosen one once and no pair of items else is made.
    """
    place = trace.select("region", F.col("item").alias("_own"), F.col("step").alias("_taken"))
    met = items.select("region", "item", "support").join(trace.select("region", "step", F.col("item").alias("winner")), "region")
    cos = similar(met.select(F.col("item").alias("left"), F.col("winner").alias("right")).distinct()).select(F.col("left").alias("item"), F.col("right").alias("winner"), "c")
    before = Window.partitionBy("region", "item").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.join(cos, ["item", "winner"]).withColumn("redundancy", F.max("c").over(before))
    rows = rows.join(place.withColumnRenamed("_own", "item"), ["region", "item"], "left").where((F.col("step") > 0) & (F.col("_taken").isNull() | (F.col("_taken") >= F.col("step"))))
    score = F.col("support") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("redundancy")))
    return rows.select("region", "step", "item", "support", "redundancy", score.alias("score"), (F.col("item") == F.col("winner")).alias("chosen"))


def replay_faults(trace: DataFrame, items: DataFrame, similar: Callable[[DataFrame], DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """region, step, item and fault of a trace that also has the recorded support, redundancy and score of each step from 1.

    Faults: a recorded part that isn't what the replay gives (the part's name), an open item that beats the winner (beaten, with that item), a winner that isn't an open item of its region (no_candidate), an item that wins twice
    (repeated), and a step that is missing (gap).
    """
    twice = trace.groupBy("region", "item").agg(F.max("step").alias("step"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("region", "step", "item", F.lit("repeated").alias("fault"))
    last = trace.groupBy("region").agg(F.max("step").alias("_last"), F.count_distinct("step").alias("_n"), F.min("step").alias("_first"))
    gap = last.where((F.col("_last") - F.col("_first") + 1 != F.col("_n")) | (F.col("_first") != 0)).select("region", F.col("_last").alias("step"), F.lit(None).cast(dict(trace.dtypes)["item"]).alias("item"), F.lit("gap").alias("fault"))
    once = trace.groupBy("region", "item").agg(F.min("step").alias("step"))
    played = competition(once, items, similar)
    winner = played.where("chosen").select("region", "step", "item", *(F.col(p).alias(f"_{p}") for p in PARTS))
    told = trace.where("step > 0").join(winner, ["region", "step", "item"], "left")
    off = lambda p: F.coalesce(F.abs(F.col(p) - F.col(f"_{p}")) > tolerance, F.lit(True))
    faults = F.when(F.col("_score").isNull(), F.array(F.lit("no_candidate"))).otherwise(F.filter(F.array(*(F.when(off(p), p) for p in PARTS)), lambda x: x.isNotNull()))
    parts = told.join(twice.select("region", "item", "step"), ["region", "item", "step"], "left_anti").select("region", "step", "item", F.explode(faults).alias("fault"))
    best = winner.select("region", "step", F.col("_score").alias("_won"))
    beaten = played.where("NOT chosen").join(best, ["region", "step"]).where(F.col("score") > F.col("_won") + tolerance).select("region", "step", "item", F.lit("beaten").alias("fault"))
    return twice.unionByName(gap).unionByName(parts).unionByName(beaten)


def margins(trace: DataFrame, items: DataFrame, targets: DataFrame, quotas: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """How each target (region, item) fared under each quota (region, name, quota): how it ended, the step that settled it, its score there, the winner's, and their margin; and the chosen item most like it.

    Ends: protected_anchor, selected, no_open_slot (a quota of the anchor alone), lost_at_last_slot.
    """
    played = competition(trace, items, similar)
    place = trace.select("region", "item", F.col("step").alias("place"))
    each = targets.select("region", "item").join(quotas, "region").join(place, ["region", "item"], "left")
    kept = F.coalesce(F.col("place") < F.col("quota"), F.lit(False))
    end = F.when(F.col("place") == 0, "protected_anchor").when(kept, "selected").when(F.col("quota") == 1, "no_open_slot").otherwise("lost_at_last_slot")
    settled = F.when(end == "selected", F.col("place")).when(end == "lost_at_last_slot", F.least(F.col("quota") - 1, F.col("_last")))
    last = trace.groupBy("region").agg(F.max("step").alias("_last"))
    each = each.join(last, "region").select("region", "item", "name", "quota", end.alias("end"), settled.alias("step"))
    own = played.select("region", "step", "item", F.col("score").alias("target_score"))
    won = played.where("chosen").select("region", "step", F.col("score").alias("winner_score"))
    chosen = trace.select("region", F.col("item").alias("winner"), F.col("step").alias("_at"))
    pairs = each.select("region", "item", "name", "quota").join(chosen, "region").where(F.col("_at") < F.col("quota"))
    cos = similar(pairs.select(F.col("item").alias("left"), F.col("winner").alias("right")).distinct()).select(F.col("left").alias("item"), F.col("right").alias("winner"), "c")
    like = pairs.join(cos, ["item", "winner"]).groupBy("region", "item", "name").agg(F.min(F.struct(-F.col("c"), F.col("_at"), F.col("winner"))).alias("_m"))
    out = each.join(own, ["region", "step", "item"], "left").join(won, ["region", "step"], "left").join(like, ["region", "item", "name"])
    return out.select("region", "item", "name", "quota", "end", "step", "target_score", "winner_score", (F.col("winner_score") - F.col("target_score")).alias("margin"), F.col("_m.winner").alias("representative"), (-F.col("_m.col1")).alias("cosine"))


def checked_selection(pool: DataFrame, keys: Sequence[str], item: str, select: Callable[[DataFrame], DataFrame], inspect: Callable[[DataFrame], DataFrame], saved: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Selections without unfit rows, and the rows that were found unfit (keys, item, round).

    select takes a pool and returns the rows that it chooses; inspect takes chosen rows (keys, item) and returns those that are unfit, so only what is chosen is ever looked at. Questions that chose an unfit row choose again
    without it, until none does: each round bans a row at least, so this ends. A question that has no rows left to choose from is an error. saved writes a table and reads it again.
    """
    by = [*keys, item]
    picks = saved(select(pool), "picks")
    done, open_, banned, seen, turn = None, picks, None, None, 0
    while True:
        fresh = open_.select(*by).distinct() if seen is None else open_.select(*by).distinct().join(seen, by, "left_anti")
        unfit = saved(inspect(fresh).select(*by).distinct().withColumn("round", F.lit(turn)), "unfit")
        again = unfit.select(*keys).distinct()
        fit = open_.join(again, list(keys), "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if unfit.isEmpty():
            return done, (banned if banned is not None else unfit)
        seen = fresh if seen is None else saved(seen.unionByName(fresh).join(again, list(keys), "left_semi"), "seen")
        banned = unfit if banned is None else banned.unionByName(unfit)
        left = pool.join(again, list(keys), "left_semi").join(banned, by, "left_anti")
        open_ = saved(select(left), "picks")
        if not again.join(open_.select(*keys).distinct(), list(keys), "left_anti").isEmpty():
            raise ValueError("a question has no fit rows left")
        turn += 1
