"""Mixing sources to target weights by pivotal dependent rounding: DataFrame functions only.

Each document is to be taken target / source_size times on average. The whole part is certain; the fraction is a copy
probability. Documents of a source are put in buckets of about FAN by hash. A bucket is folded: the carried document and the
next one trade word mass at random, either way, in the ratio that leaves both expectations as they are, until one of them is
taken or left for good; the other is carried on. So words of a bucket stay as they were to the last carry, and the
carries of FAN buckets meet in a bucket of the next level, up a tree, until a source has one; it is rounded by a coin of its
own, long documents before others. Coins are hashes, so reruns agree. A source with a third of all rows only has more buckets.

Defined cases: a null text has size 0; a null source is one source, last in order; rows that repeat doc_id, source and size
are told apart by a number; a source without words has target 0; an empty table gives an empty result; other columns
are ignored by mix_sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table

FAN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, n_rows, target: one row a source.

    share of all words is dealt by weight; what exceeds most times a source's words goes to the others by weight. With
    sources ordered by most * size / weight, those below the common level are the full ones, so sums over that order find it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        rows.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("water", (F.col("all_words") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    )
    # the first source in order that isn't full sets the level of all that aren't
    first = F.min(F.when(F.col("water") < F.col("level"), F.struct("level", "rank", "water"))).over(everything)
    seen = seen.withColumn("common", first["water"])
    return seen.select("source", "source_size", "n_rows", F.coalesce(F.least("cap", F.col("weight") * F.col("common")), F.col("cap")).alias("target"))


def _coin(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _fold(items: Column, seed: int, level: int) -> Column:
    """items: array of (id, occ, size, p). Struct of the carried item and those that are settled."""

    def step(s: Column, b: Column) -> Column:
        a = s["carry"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        rise = (_coin(F.lit(seed), F.lit(level), a["id"], a["occ"], b["id"], b["occ"]) * (up + down)) < down
        # p of a and of b once mass has moved; the one that came to its end is set to 0 or 1 exactly
        up_a = F.when((1 - a["p"]) * a["size"] <= b["p"] * b["size"], F.lit(1.0)).otherwise(a["p"] + up / a["size"])
        up_b = F.when((1 - a["p"]) * a["size"] >= b["p"] * b["size"], F.lit(0.0)).otherwise(b["p"] - up / b["size"])
        down_a = F.when(a["p"] * a["size"] <= (1 - b["p"]) * b["size"], F.lit(0.0)).otherwise(a["p"] - down / a["size"])
        down_b = F.when(a["p"] * a["size"] >= (1 - b["p"]) * b["size"], F.lit(1.0)).otherwise(b["p"] + down / b["size"])
        whole = lambda x: (x == 0.0) | (x == 1.0)
        stays = whole(a["p"]) | whole(b["p"])
        pa_ = F.when(stays, a["p"]).when(rise, up_a).otherwise(down_a)
        pb_ = F.when(stays, b["p"]).when(rise, up_b).otherwise(down_b)
        item = lambda x, p: F.struct(x["id"].alias("id"), x["occ"].alias("occ"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p"))
        a2, b2 = item(a, pa_), item(b, pb_)
        return F.struct(F.when(whole(a2["p"]), b2).otherwise(a2).alias("carry"), F.concat(s["settled"], F.array(F.when(whole(a2["p"]), a2).otherwise(b2))).alias("settled"))

    start = F.struct(items[0].alias("carry"), F.filter(items, lambda x: F.lit(False)).alias("settled"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), start, step)


def _settle(items: DataFrame, most: int, seed: int, tag: int, scratch: Scratch) -> DataFrame:
    """source, id, occ, size, base, p with p 0 or 1. items: those and n_buckets; most: rows of the largest source."""
    level, k, settled = items, 0, []
    while most > 1 or k == 0:
        buckets = level.groupBy("source", "n_buckets", F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.lit(k), "id", "occ", "size"), F.col("n_buckets")).alias("bucket"))
        order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), F.lit(k), "id", "occ").alias("o"), F.struct("id", "occ", "size", "base", "p").alias("x"))))
        folded = scratch.save(buckets.agg(F.transform(order, lambda x: x["x"]).alias("items")).select("source", "n_buckets", _fold(F.col("items"), seed + tag, k).alias("f")), f"level{tag}-{k}")
        settled.append(folded.select("source", F.explode("f.settled").alias("x")).select("source", "x.*"))
        level = folded.select("source", F.ceil(F.col("n_buckets") / FAN).alias("n_buckets"), "f.carry.*")
        most, k = -(-most // FAN), k + 1
    last = F.when(_coin(F.lit(seed), F.lit(tag), F.lit("last"), F.col("id"), F.col("occ"), F.col("size")) < F.col("p"), 1.0).otherwise(0.0)
    done = level.select("source", "id", "occ", "size", "base", last.alias("p"))
    for x in settled:
        done = done.unionByName(x)
    return done


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, occ, size, source_size, target, copies, taken, one row for each row of docs (doc_id, text, source).

    The carry of the last bucket is rounded by itself, which moves the total by up to its size, and long documents tend to be
    carried on. So documents of over 1/8, 1/64 and 1/512 of their source's words (8, 64 and 512 at most) are settled
    first, each time at the rate that the words still missing need of the documents still open, then all others.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    same = sizes.groupBy("doc_id", "source", "size").count()
    sizes = scratch.save(same.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("occ")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, share, most), "targets")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    phase = F.when(F.col("size") * 8 > F.col("source_size"), 0).when(F.col("size") * 64 > F.col("source_size"), 1).when(F.col("size") * 512 > F.col("source_size"), 2).otherwise(3)
    items = sizes.join(t, sizes["source"].eqNullSafe(t["_source"])).select("source", F.col("doc_id").alias("id"), "occ", "size", phase.alias("phase"))
    each = scratch.save(items.groupBy("source", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "phases")
    largest = {r["phase"]: r["n"] for r in each.groupBy("phase").agg(F.max("n").alias("n")).collect()}
    parts: list[DataFrame] = []
    for k in sorted(largest):
        open_ = each.where(F.col("phase") >= k).groupBy("source").agg(F.sum("words").alias("open"), F.sum(F.when(F.col("phase") == k, F.col("n"))).alias("n"))
        state = t.join(open_.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "target", "open", "n")
        taken = F.lit(0)
        if parts:
            so_far = parts[0]
            for x in parts[1:]:
                so_far = so_far.unionByName(x)
            so_far = so_far.groupBy(F.col("source").alias("_t")).agg(F.sum((F.col("base") + F.col("p")) * F.col("size")).alias("got"))
            state = state.join(so_far, F.col("_source").eqNullSafe(F.col("_t")), "left")
            taken = F.coalesce("got", F.lit(0.0))
        rate = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - taken) / F.col("open")))).otherwise(0.0)
        state = state.select("_source", F.greatest(F.ceil(F.col("n") / FAN), F.lit(1)).alias("n_buckets"), rate.alias("rate"))
        now = items.where(F.col("phase") == k)
        now = now.join(state, now["source"].eqNullSafe(state["_source"])).select("source", "n_buckets", "id", "occ", "size", F.floor("rate").alias("base"), F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"))
        parts.append(_settle(now, largest[k], seed, k, scratch))
    done = sizes.select("source", F.col("doc_id").alias("id"), "occ", "size", F.lit(0).cast("long").alias("base"), F.lit(0.0).alias("p")).limit(0) if not parts else parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.join(t, done["source"].eqNullSafe(t["_source"])).select(F.col("id").alias("doc_id"), "source", "occ", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(alone(table(spark, sf_dir, "documents"), "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
