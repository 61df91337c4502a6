"""Line deduplication: DataFrame functions only.

Lines become 128-bit hashes of their keys. A doc and key pair is one row, dealt by range over (hash, salt), where the
salt is of the document, so that a line found in a third of all documents spreads over SALTS groups. Within a group,
sorted by document and position, first occurrences are streamed; at most SALTS partial rows a key meet again to give its
number of documents and its first place. What comes back to a document is a bitmap of the lines it keeps, as lengths of runs.

Defined cases: a null or empty text is one empty line; empty keys (blank lines) are always kept; rows with one doc_id
count as one document in document counts but keep their own rows; rows without a doc_id are told apart by their text;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, alone, table

SALTS = 64
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, scratch: Scratch, min_chars: int = 1, min_docs: int | None = None) -> DataFrame:
    """doc_id, row_key, n_lines, n_dropped, keep (binary, a bitmap compressed to run lengths) of the documents that lose lines.

    min_docs: keys found in so many documents lose all their lines; None: keys keep their first occurrence, by doc_id and
    position, and lose all others. Keys of fewer than min_chars code points stay.
    """
    base = docs.select("doc_id", F.col("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    keys = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)))
    lines = (
        base.select("doc_id", "row_key", F.posexplode(keys).alias("pos", "key"))
        .where(F.char_length("key") >= max(1, min_chars))
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), F.coalesce("doc_id", "row_key").alias("doc"))
        .withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    )
    lines = scratch.save(lines, "lines")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lines.repartitionByRange(parts, "h1", "h2", "salt")
    within = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "row_key", "pos")
    marked = dealt.withColumn("opens", (~F.col("doc").eqNullSafe(F.lag("doc").over(within))).cast("long"))
    partial = marked.groupBy("h1", "h2", "salt").agg(F.sum("opens").alias("docs"), F.min(F.struct("doc", "row_key", "pos")).alias("first"))
    by_key = Window.partitionBy("h1", "h2")
    whole = partial.withColumn("n_docs", F.sum("docs").over(by_key)).withColumn("head", F.min("first").over(by_key))
    if min_docs is None:
        hit = lines.join(whole.select("h1", "h2", "salt", "head"), ["h1", "h2", "salt"]).where(F.struct("doc", "row_key", "pos") != F.col("head"))
    else:
        hit = lines.join(whole.where(F.col("n_docs") >= min_docs).select("h1", "h2", "salt"), ["h1", "h2", "salt"])
    drops = hit.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))
    counted = base.select("doc_id", "row_key", F.size(_lines(F.col("text"))).alias("n_lines")).dropDuplicates(["doc_id", "row_key"])
    both = counted.join(drops, counted["doc_id"].eqNullSafe(drops["doc_id"]) & (counted["row_key"] == drops["row_key"])).select(counted["*"], "dropped")
    return both.select("doc_id", "row_key", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), _pack(F.col("dropped")).alias("keep"))


def _pack(dropped: Column) -> Column:
    """The bitmap of a document's lines as lengths of runs, kept and dropped in turn, 4 bytes each; what follows the last run is kept.

    Runs come from differences of whole arrays, so this is linear in the lines that go.
    """
    order = F.sort_array(dropped)
    after = F.transform(order, lambda x: x + 1)
    starts, ends = F.array_except(order, after), F.array_except(after, order)
    kept = F.zip_with(starts, F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(starts)), lambda s, e: s - e)
    runs = F.flatten(F.zip_with(kept, F.zip_with(starts, ends, lambda s, e: e - s), lambda k, d: F.array(k, d)))
    return F.unhex(F.array_join(F.transform(runs, lambda n: F.lpad(F.hex(n), 8, "0")), ""))


def _bits(keep: Column) -> Column:
    """Of a packed bitmap, whether each line goes, up to the last that does."""
    lengths = F.split(F.regexp_replace(F.hex(keep), "(.{8})(?=.)", "$1 "), " ")
    return F.flatten(F.transform(lengths, lambda x, i: F.array_repeat(i % 2 == 1, F.conv(x, 16, 10).cast("int"))))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text as its bitmap leaves it, and n_lines and n_dropped."""
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "n_dropped", "keep")
    joined = keyed.join(b, keyed["doc_id"].eqNullSafe(b["_id"]) & (keyed["_row_key"] == b["_key"]), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(F.zip_with(lines, _bits(F.col("keep")), lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x)), lambda x: x.isNotNull())
    return joined.select(
        *(F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 1, min_docs: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text and others) with the lines that are left, and n_lines and n_dropped."""
    scratch = scratch or Scratch(docs.sparkSession)
    return keep_lines(docs, keep_bitmaps(alone(docs, "doc_id", "text"), scratch, min_chars, min_docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(alone(table(spark, sf_dir, "documents"), "doc_id", "text"), min_chars=1, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""
QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE_SQL = {"op8_line_dedup": SQL}
