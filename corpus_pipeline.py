"""A corpus in stages: each works on all documents that the one before it kept, and its decisions take effect.

Toxic documents go; lines found in ten documents or more go; of near-duplicates (five-word shingles, similarity 0.8) the one
with the smallest doc_id stays; contaminated documents go; sources are mixed to target weights, and documents that the
mix takes leave with their number of copies.

Decisions are by row, not by doc_id: rows that share an id, or have none, are judged by their own texts. In near-dedup rows that
agree in all columns are one, and of a group without any doc_id the row with the smallest key stays. Documents without a text pass all
filters (the mix takes none of them, as they have no words); empty tables give empty results; columns other than COLUMNS go no further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm._shared import Scratch, alone, table
from keelson.llm.decontaminate import contaminated_spans, verdicts
from keelson.llm.line_dedup import line_dedup
from keelson.llm.minhash import near_duplicates
from keelson.llm.mixing import mix_sources, word_count
from keelson.llm.toxicity import fit, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = alone(docs, *COLUMNS)
    model = fit(docs, alone(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    return toxicity(docs, model, keep_text=True).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(alone(docs, *COLUMNS), min_chars=1, min_docs=10)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = alone(docs, *COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS))
    ids = docs.select(F.col("_row").alias("_id"), F.col("doc_id").alias("_doc")).distinct()
    nodes = near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text"), n=5, percent=80, scratch=scratch).select("doc_id", "component_id").distinct()
    first = nodes.join(ids, nodes["doc_id"] == ids["_id"]).groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_id")).alias("first"))
    stays = scratch.save(first.select(F.col("first._id").alias("_id")), "stays")
    return docs.join(stays, docs["_row"] == stays["_id"], "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = alone(docs, *COLUMNS)
    found = verdicts(contaminated_spans(docs.select("doc_id", "text"), alone(table(spark, sf_dir, "benchmark"), "item_id", "text")))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == bad["_key"]), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, size, source_size, target and taken."""
    docs = alone(docs, *COLUMNS)
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    key = ["doc_id", "source", "size"]
    own = docs.withColumn("size", word_count(F.col("text")))
    own = own.withColumn("occ", F.row_number().over(Window.partitionBy(*key).orderBy("text", "lang", "n_chars")))
    taken = mixed.where("copies > 0").select(*(F.col(c).alias(f"_{c}") for c in (*key, "occ")), "source_size", "target", "copies", "taken")
    same = own["size"] == taken["_size"]
    for c in ("doc_id", "source", "occ"):
        same &= own[c].eqNullSafe(taken[f"_{c}"])
    return own.join(taken, same).select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again, so nothing upstream runs twice."""
    scratch, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
