"""Benchmark decontamination by a prefix-filtered set join.

A window of an item (WINDOW words in a row; a shorter item whole) is a set of (shingle, place) elements. Shingles are
ordered by rarity, as counted over all documents. At a containment of 1, a document that holds a window holds each of its
shingles, so the necessary prefix is one element, its rarest; windows whose rarest shingle no document holds go no further. Where a document has
that shingle, its place in the window fixes where the window would begin (positional bound) and end (length bound); there all
words are compared with the window's. A lower containment t keeps the m - ceil(t m) + 1 rarest of m elements and counts equal
words of the item-sized window instead.

Documents are read twice, however large the benchmark is: to count the benchmark's shingles, and to bring out the places of prefix
shingles with the words around them. Both times a bitmap of 2^SPOTS bits (8 MB, whatever the benchmark's size) lets shingles through;
those it lets through in error find no partner in the join. Counts, places and windows meet by shingle on the cluster; texts aren't
shuffled, and neither shingles nor windows reach the driver.

Defined cases: a null text has no words; an item without words has no window; items and documents that repeat an id are
rows of their own (an item_id counts once in n_items); items without item_id hit words, but count in no items; an empty benchmark hits nothing; n_words 0 is never contaminated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table
from ._text import ALNUM, U, Words, buffers, long_list, mix, pieces

WINDOW, GRAM, SPOTS = 13, 3, 26


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (wrong for the last n - 1)."""
    out = np.zeros(len(h), U)
    for k in range(n):
        out[: len(h) - k] = mix(out[: len(h) - k] * U(0xD6E8FEB86659FD93) + h[k:])
    return out


def _spots(marks: np.ndarray, gram: int, bits: int) -> np.ndarray:
    """The place of each shingle in the bitmap of 2^bits."""
    return (mix(marks ^ U(gram)) >> U(64 - bits)).astype(np.int64)


def _bitmap(spots: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column spot, put together on the cluster; 2^bits bits at most come to the driver."""
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(spot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    return out


def _item_windows(window: int, gram: int, bits: int):
    """item_id, words (their hashes) and shingles (of gram words; of all words if there are fewer) of each window, with the shingles' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, marks, spots, grams = [], [], [], [], []
            buf, off = buffers(batch.column("text"))
            w = Words(buf, off, ALNUM)
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                h = w.hash[w.at[i] : w.at[i + 1]]
                for k in range(max(0, len(h) - window) + 1) if len(h) else ():
                    own = h[k : k + window]
                    g = min(gram, len(own))
                    ids.append(item)
                    words.append(own.view(np.int64))
                    mark = _grams(own, g)[: len(own) - g + 1]
                    marks.append(mark.view(np.int64))
                    spots.append(_spots(mark, g, bits))
                    grams.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64())), pa.array(spots, pa.list_(pa.int64())), pa.array(grams, pa.int32())], ["item_id", "words", "marks", "spots", "gram"])

    return run


def _through(w: Words, g: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles of g words that the bitmap lets through."""
    pos = _whole(w, g)
    h = _grams(w.hash, g)[pos]
    spot = _spots(h, g, int(len(bitmap)).bit_length() + 5)
    ok = (bitmap[spot >> 6] >> (spot & 63).astype(U)) & U(1) > 0
    return pos[ok], h[ok]


def _gram_counts(grams: list[int], sent):
    """How often shingles that the bitmap lets through occur in the documents of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {g: [] for g in grams}

        def out() -> Iterator[pa.RecordBatch]:
            for g, parts in held.items():
                if parts:
                    k, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "mark", "n"])
                    parts.clear()

        size = 0
        for batch in batches:
            for b in pieces(batch, "text"):
                w = Words(*buffers(b.column("text")), ALNUM)
                for g in grams:
                    held[g].append(_through(w, g, sent.value)[1])
                    size += len(held[g][-1])
            if size > 1 << 21:
                yield from out()
                size = 0
        yield from out()

    return run


def _whole(w: Words, n: int) -> np.ndarray:
    """Words that n - 1 others follow in their text."""
    left = np.repeat(w.at[1:], np.diff(w.at)) - np.arange(len(w.hash))
    return np.flatnonzero(left >= n)


def _places(grams: list[int], window: int, sent):
    """Rows of documents with n_words, and the places of shingles that the bitmap lets through, with the words around them from start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                w = Words(*buffers(b.column("text")), ALNUM)
                got = [_through(w, g, sent.value) for g in grams]
                gram = np.repeat(np.array(grams, np.int32), [len(p) for p, _ in got])
                pos, mark = (np.concatenate(x) for x in zip(*got, strict=True))
                doc = np.searchsorted(w.at, pos, "right") - 1
                order = np.argsort(doc, kind="stable")
                gram, pos, mark, doc = gram[order], pos[order], mark[order], doc[order]
                lo, hi = np.maximum(pos - window, w.at[doc]), np.minimum(pos + window, w.at[doc + 1])
                n = hi - lo
                at = np.concatenate([[0], np.cumsum(n)])
                around = w.hash[np.arange(at[-1]) - np.repeat(at[:-1] - lo, n)]
                base = w.at[doc]
                fields = [pa.array(gram), pa.array(mark.view(np.int64)), pa.array(pos - base), pa.array(lo - base), long_list(around, at)]
                places = pa.StructArray.from_arrays(fields, ["gram", "mark", "pos", "start", "around"])
                rows = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)), places)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(np.diff(w.at)), rows], ["doc_id", "row_key", "n_words", "places"])

    return run


def _united(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    start = F.filter(spans, lambda x: F.lit(False))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one(F.try_element_at(acc, F.lit(-1))["start"], F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"])))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = 1.0, gram: int = GRAM, bits: int = SPOTS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, row_key, n_words, spans (array of word start and end), items (array of item_id), one row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    windows = benchmark.select("item_id", "text").mapInArrow(_item_windows(window, gram, bits), "item_id long, words array<long>, marks array<long>, spots array<long>, gram int")
    windows = windows.groupBy("item_id", "words").agg(F.first("marks").alias("marks"), F.first("spots").alias("spots"), F.first("gram").alias("gram"))
    windows = scratch.save(windows.withColumn("win", F.xxhash64("item_id", "words")), "windows")
    grams = sorted(r["gram"] for r in windows.select("gram").distinct().collect()) or [gram]  # gram values at most
    sent = spark.sparkContext.broadcast(_bitmap(windows.select(F.explode("spots").alias("spot")), bits))
    rarity = scratch.save(keyed.select("text").mapInArrow(_gram_counts(grams, sent), "gram int, mark long, n long").groupBy("gram", "mark").agg(F.sum("n").alias("n")), "rarity")
    places = windows.select("win", "item_id", "words", "gram", F.posexplode(F.arrays_zip("marks", "spots")).alias("place", "m")).select("win", "item_id", "words", "gram", "place", F.col("m.marks").alias("mark"), F.col("m.spots").alias("spot"))
    ranked = places.join(rarity, ["gram", "mark"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "mark", "place")))
    # an element of the window is lost with each word that differs, up to gram of them
    lost = F.floor((1 - F.lit(float(containment))) * F.size("words") + 1e-9) * F.col("gram")
    prefix = scratch.save(ranked.where(F.col("rank") <= lost + 1).where("n IS NOT NULL").select("item_id", "words", "gram", "mark", "spot", "place"), "prefix")
    sent = spark.sparkContext.broadcast(_bitmap(prefix.select("spot"), bits))
    kind = "array<struct<gram:int,mark:long,pos:long,start:long,around:array<long>>>"
    rows = scratch.save(keyed.mapInArrow(_places(grams, window, sent), f"doc_id long, row_key long, n_words long, places {kind}"), "rows")
    scratch.drop(rarity)
    met = rows.select("doc_id", "row_key", "n_words", F.explode("places").alias("p")).select("doc_id", "row_key", "n_words", "p.*").join(prefix.drop("spot"), ["gram", "mark"])
    begin, size = F.col("pos") - F.col("place"), F.size("words")
    met = met.where((begin >= F.col("start")) & (begin + size <= F.col("n_words"))).withColumn("own", F.slice("around", (begin - F.col("start") + 1).cast("int"), size))
    same = F.col("own") == F.col("words") if containment >= 1 else F.size(F.filter(F.zip_with("own", "words", lambda x, y: x == y), lambda x: x)) >= F.ceil(F.lit(float(containment)) * size - 1e-9)
    span = F.struct(begin.alias("start"), (begin + size).alias("end"))
    hits = met.where(same).groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(_united(F.collect_set(span)).alias("spans"), F.collect_set("item_id").alias("items"))
    out = rows.drop("places").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    return out.select("doc_id", "row_key", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def verdicts(spans: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated (a share-th of the words or more is hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    named = F.array_join(F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string"))), ",")
    out = spans.select("doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = alone(table(spark, sf_dir, "documents"), "doc_id", "text"), alone(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return verdicts(contaminated_spans(docs, items)).drop("row_key")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
v AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, i, v.m FROM v JOIN p ON v.k = p.k AND v.m = p.m),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL = {"op4_decontamination": SQL}
