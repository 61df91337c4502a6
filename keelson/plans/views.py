"""Candidate, vector and result tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking, temporal

HOUR = 3_600_000_000
GAP, RADIUS, SEEDS, BLOCK = 24 * HOUR, 12 * HOUR, 16, 500
QUESTION = ["question_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as candidates of a question: time in microseconds, index in time order, score within 0 and 1."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("source_pts"), "value", "ts")
    w = Window.partitionBy("question_id")
    rows = e.withColumn("candidate_index", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("score", F.col("value") / F.max("value").over(w))
    return rows.drop("value", "ts")


def bounds(c: DataFrame) -> DataFrame:
    return c.groupBy("question_id").agg(F.min("source_pts").alias("low"), F.max("source_pts").alias("high"))


def cores(c: DataFrame, seeds: int = SEEDS) -> DataFrame:
    return temporal.gap_sessions(ranking.top_k(c, QUESTION, seeds), QUESTION, "source_pts", GAP, ["candidate_index"])


def windows(c: DataFrame, n: int = SEEDS) -> DataFrame:
    seeds = cores(c, n).join(bounds(c), QUESTION)
    return temporal.core_windows(seeds, QUESTION, "source_pts", RADIUS, F.first("low"), F.first("high"))


def regions(c: DataFrame, seeds: int = SEEDS) -> DataFrame:
    return temporal.regions(windows(c, seeds), QUESTION)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of questions of BLOCK vectors each, with a region (by label in its question) and a score within 0 and 1."""
    question = F.floor(F.col("vec_id") / BLOCK)
    return table(spark, sf_dir, "embeddings").select(question.alias("question"), "vec_id", "embedding", (question * 100 + F.col("label")).alias("region"), (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 101.0).alias("score"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness of two methods by document, with stratum and cluster."""
    l_ = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return l_.join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"), F.col("source").alias("cluster")), "doc_id")


#: the same views in SQL
SQL_C = """c AS (SELECT user_id AS question_id, event_id, event_type, epoch_us(ts) AS source_pts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS candidate_index, value / max(value) OVER (PARTITION BY user_id) AS score FROM events)"""
SQL_B = """b AS (SELECT question_id, min(source_pts) AS low, max(source_pts) AS high FROM c GROUP BY question_id)"""
SQL_S = f"""{SQL_C}, {SQL_B}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c) WHERE rk <= {SEEDS}),
k AS (SELECT *, sum(o) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) AS core_id FROM (SELECT *, CASE WHEN source_pts - lag(source_pts) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) > {GAP} THEN 1 ELSE 0 END AS o FROM s))"""
SQL_R = f"""{SQL_S}, w AS (SELECT question_id, core_id, count(*) AS seeds, greatest(min(source_pts) - {RADIUS}, low) AS l, least(max(source_pts) + {RADIUS}, high) AS r FROM k JOIN b USING (question_id) GROUP BY question_id, core_id, low, high),
i AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS region_id FROM (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w)),
g AS (SELECT question_id, region_id, min(l) AS l, max(r) AS r, CAST(sum(seeds) AS BIGINT) AS m, count(*) AS c, CAST(1 + sum(seeds) - count(*) AS BIGINT) AS weight, max(seeds) >= 3 AS refine FROM i GROUP BY question_id, region_id)"""
SQL_V = f"""v AS (SELECT vec_id // {BLOCK} AS question, vec_id, (vec_id // {BLOCK}) * 100 + label AS region, e, sqrt(list_dot_product(e, e)) AS n, ((vec_id * 37) % 101) / 101.0::DOUBLE AS score FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
SQL_T = """t AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b, lang AS stratum, source AS cluster FROM labels JOIN documents USING (doc_id))"""
