"""How filters interact: what each removes at each place of each order, from a packed bitmap index.

1. Each row's filters and labels are marked. Equal texts are found through their digests: the smallest doc_id of each digest, by a
   map-side combined minimum; digests that hold more than a 4,096th of all rows (so fewer than 4,096 of them) are sent to every task,
   the others are joined by key, so that no key of the join holds a large share of the rows.
2. The index: for each block of at most 8,192 rows of a partition, a bitset of its rows for each filter, label and part, packed by numpy.
   Nothing is shuffled for it, and blocks bound what a task holds, whatever the number of parts.
3. For each set of filters that can stand before a step (2^n sets), the rows that it leaves are the part's bits AND NOT each filter's;
   their popcounts, and those of their AND with each label, are summed over blocks. Every count of the audit is a difference of such sums.

Defined cases: a null text is an empty one, a null part is the empty string; a row without doc_id neither repeats nor is repeated, and has no
labels; rows that repeat a doc_id are documents each, equal texts of one id don't repeat each other; of contradictory labels 1 counts; a label
without a document counts nowhere; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table

BLOCK, HOT_SHARE = 8_192, 4_096
WORD = r"[^\x20\x09-\x0D]+"
INDEX = "parts array<string>, part_bits array<binary>, filter_bits array<binary>, label_bits array<binary>"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that see one text: A too short, B repetitive, C shouting, D signs of mark-up. text isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def with_repeats(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows (saved ones: they are read twice) and whether another row of the same key has a smaller value of order."""
    groups = rows.where(F.col(order).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_first < _last")
    most = rows.count() // HOT_SHARE
    hot = groups.where(F.col("_n") > most).select(F.col(key).alias("_k"), F.col("_first").alias("_hot"))  # fewer than HOT_SHARE rows
    rest = groups.where(F.col("_n") <= most).select(F.col(key).alias("_key"), "_first")
    rows = rows.join(F.broadcast(hot), rows[key] == F.col("_k"), "left").drop("_k")
    # rows of hot keys have their answer and would only crowd one task of the next join
    met = rows.where("_hot IS NULL").join(rest, F.col(key) == F.col("_key"), "left").drop("_key", "_hot")
    return met.unionByName(rows.where("_hot IS NOT NULL").withColumnRenamed("_hot", "_first")).withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def with_labels(rows: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows and, of each label, whether it is 1 for the row's doc_id."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in columns))
    known = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    none = rows.where("doc_id IS NULL")  # not joined: without an id they would all meet in one task
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in columns}).unionByName(none.withColumns({c: F.lit(False) for c in columns}))


def bitmap_index(rows: DataFrame, part: str, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Blocks of packed bitsets (INDEX) of boolean columns that aren't null, and of the values of a string column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                codes = b.column(0).dictionary_encode()
                values, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
                flags = [np.packbits(c.to_numpy(zero_copy_only=False)).tobytes() for c in b.columns[1:]]
                own = [np.packbits(code == k).tobytes() for k in range(len(values))]
                cut = len(filters)
                yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.binary())) for x in (own, flags[:cut], flags[cut:]))], ["parts", "part_bits", "filter_bits", "label_bits"])

    return rows.select(part, *filters, *labels).mapInArrow(pack, INDEX)


def survivors(index: DataFrame, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """part, gone (a set of filters, as bits), left_all and left_<label>: rows of the part that fail none of the set, and of those the labelled ones."""
    n = len(filters)
    kinds = ["all", *labels]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                bits = [[np.frombuffer(x, np.uint8) for x in row[k]] for k in ("part_bits", "filter_bits", "label_bits")]
                for part, own in zip(row["parts"], bits[0], strict=True):
                    left = [own]  # by set of filters: that of the set without its highest filter, AND NOT this one
                    for f in range(n):
                        left += [x & ~bits[1][f] for x in left]
                    got = np.array([[int(np.bitwise_count(x & y).sum()) for y in (own, *bits[2])] for x in left], np.int64)
                    sums[part] = sums[part] + got if part in sums else got
            if len(sums) > BLOCK:
                yield told(sums)
                sums = {}
        yield told(sums)

    def told(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate([*sums.values(), np.zeros((0, len(kinds)), np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p in sums for _ in range(1 << n)], pa.string()), pa.array(np.tile(np.arange(1 << n, dtype=np.int32), len(sums))), *(pa.array(found[:, k]) for k in range(len(kinds)))],
            ["part", "gone", *(f"left_{k}" for k in kinds)],
        )

    sums = index.mapInArrow(count, "part string, gone int, " + ", ".join(f"left_{k} long" for k in kinds))
    return sums.groupBy("part", "gone").agg(*(F.sum(f"left_{k}").alias(f"left_{k}") for k in kinds))


def audit(counts: DataFrame, filters: Sequence[str], lost: dict[str, str]) -> DataFrame:
    """Of each part, order and step: what survivors() tells of it. lost: names of the counts of removed labelled rows, by label."""
    spark, n = counts.sparkSession, len(filters)
    every = (1 << n) - 1
    # a small table by number of filters: of each filter and each set of others, the orders that have just these before it
    steps = [(o, k + 1, 1 << filters.index(o[k]), sum(1 << filters.index(x) for x in o[:k])) for o in map("".join, permutations(filters)) for k in range(n)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, own int, gone int")
    turns = [(1 << f, sum(1 << x for x in s), int(np.prod(range(1, len(s) + 1), dtype=np.int64) * np.prod(range(1, n - len(s)), dtype=np.int64))) for f in range(n) for r in range(n) for s in combinations([x for x in range(n) if x != f], r)]
    turns = spark.createDataFrame(turns, "own int, gone int, orders long")
    kinds = [c for c in counts.columns if c.startswith("left_")]
    after = counts.select("part", F.col("gone").alias("then"), *(F.col(c).alias(f"then_{c[5:]}") for c in kinds))
    met = counts.join(F.broadcast(turns), "gone").withColumn("then", F.col("gone").bitwiseOR(F.col("own"))).join(after, ["part", "then"])
    each = met.select("part", "own", "gone", "orders", F.col("then_all").alias("kept"), *((F.col(c) - F.col(f"then_{c[5:]}")).alias(f"removed_{c[5:]}") for c in kinds))
    whole = each.groupBy("part", "own").agg(
        F.sum(F.col("removed_all") * F.col("orders")).alias("shapley"), F.sum(F.when(F.col("gone") == 0, F.col("removed_all"))).alias("fails"), F.sum(F.when(F.col("gone") == F.lit(every) - F.col("own"), F.col("removed_all"))).alias("unique_fails")
    )
    out = each.join(F.broadcast(plan), ["own", "gone"]).join(whole, ["part", "own"])
    return out.select("part", "filter_order", "step", "kept", F.col("removed_all").alias("removed"), (F.col("fails") - F.col("removed_all")).alias("redundant"), "unique_fails", *(F.col(f"removed_{k}").alias(v) for k, v in lost.items()), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, failures: Callable[[Column], dict[str, Column]] = text_failures, scratch: Scratch | None = None) -> DataFrame:
    """The audit of docs (doc_id, text, lang) by the filters that failures gives, and E, which fails texts that a smaller doc_id has."""
    scratch = scratch or Scratch(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = failures(F.col("text"))
    rows = scratch.save(d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in own.items())), "rows")
    marked = with_labels(with_repeats(rows, "digest", "doc_id", "E").drop("digest"), labels, ("quality", "toxic"))
    filters = [*own, "E"]
    index = scratch.save(bitmap_index(marked, "part", filters, ("quality", "toxic")), "index")
    return audit(scratch.save(survivors(index, filters, ("quality", "toxic")), "counts"), filters, {"quality": "good_lost", "toxic": "toxic_lost"})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(alone(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), alone(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) AS c,
             regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM w JOIN m ON w.t = m.t LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM i p, i q, i r, i s, i t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
x AS (SELECT part, o, i AS step, o[i] AS own, n, good, toxic, fails[o[i]] AS fail, len(list_filter(o[1:i - 1], lambda k: fails[k])) > 0 AS gone,
             len(list_filter(fails, lambda k: k)) = 1 AS one FROM g, o, i),
y AS (SELECT part, o, step, own, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND one THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fail AND NOT gone THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {"op13_filter_audit": SQL}
