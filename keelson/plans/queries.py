"""Named queries over the driver's tables, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import clipped, cosine
from ..operators import contracts, matching, pools, ranking, reports, selection, sets, statistics, temporal
from . import selector_sql
from .registry import ORACLE_SQL, QUERIES, query
from .views import HOUR, QUESTION, SQL_C, SQL_R, SQL_S, SQL_T, SQL_V, bounds, candidates, cores, regions, results, table, vectors, windows



ITEM = ["question_id", "candidate_index"]


@query(f"WITH {SQL_C} SELECT question_id, candidate_index, source_pts, score, row_number() OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) AS step FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c) WHERE rk <= 16")
def topk_per_user(spark, sf):
    return ranking.top_k(candidates(spark, sf), QUESTION, 16).select(*ITEM, "source_pts", "score", "step")


@query(f"WITH {SQL_C} SELECT question_id, candidate_index, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c) WHERE rk = 1")
def stable_argmax(spark, sf):
    return ranking.stable_argmax(candidates(spark, sf), QUESTION, "score").select(*ITEM, "score")


_UNIFORM = "WITH {c}, n AS (SELECT question_id, count(*) AS n FROM c GROUP BY question_id), p AS (SELECT DISTINCT question_id, CAST({f} AS BIGINT) AS candidate_index FROM (SELECT question_id, n, least(n, 16) AS m, unnest(range(least(n, 16))) AS j FROM n)) SELECT question_id, candidate_index, source_pts FROM c JOIN p USING (question_id, candidate_index)"


@query(_UNIFORM.format(c=SQL_C, f="round_even(CASE WHEN m > 1 THEN j * (n - 1) / (m - 1)::DOUBLE ELSE 0 END, 0)"))
def uniform_sample(spark, sf):
    return ranking.uniform_rounded(candidates(spark, sf), QUESTION, 16).select(*ITEM, "source_pts")


@query(_UNIFORM.format(c=SQL_C, f="floor(CASE WHEN m > 1 THEN j * (n - 1) / (m - 1)::DOUBLE ELSE 0 END)"))
def uniform_trunc(spark, sf):
    return ranking.uniform_truncated(candidates(spark, sf), QUESTION, 16).select(*ITEM, "source_pts")


@query(f"WITH {SQL_C} SELECT question_id, candidate_index, rank() OVER (PARTITION BY question_id ORDER BY score) - 1 AS below FROM c")
def strict_rank(spark, sf):
    return ranking.strict_rank(candidates(spark, sf), QUESTION).select(*ITEM, F.col("below").cast("long").alias("below"))


_VIEWS = "x AS (SELECT question_id, source_pts, candidate_index, 'score' AS v, score AS s FROM c UNION ALL SELECT question_id, source_pts, candidate_index, 'late', ((event_id * 7) % 97) / 97.0::DOUBLE FROM c)"


@query(f"WITH {SQL_C}, {_VIEWS}, y AS (SELECT *, row_number() OVER (PARTITION BY question_id, v ORDER BY s DESC, source_pts, candidate_index) AS r FROM x), z AS (SELECT question_id, source_pts, candidate_index, min(r) AS best_rank FROM y GROUP BY ALL), f AS (SELECT question_id, candidate_index, best_rank, row_number() OVER (PARTITION BY question_id ORDER BY best_rank, source_pts, candidate_index) AS fused_rank FROM z) SELECT * FROM f WHERE fused_rank <= 16")
def rank_fusion_min(spark, sf):
    c = candidates(spark, sf)
    two = F.explode(F.array(F.struct(F.lit("score").alias("view"), F.col("score").alias("s")), F.struct(F.lit("late").alias("view"), (F.pmod(F.col("event_id") * 7, F.lit(97)) / 97.0).alias("s"))))
    v = c.select("question_id", "source_pts", "candidate_index", two.alias("v")).select("question_id", "source_pts", "candidate_index", "v.*")
    return ranking.fused_min(v, QUESTION, "view", ["source_pts", "candidate_index"], 16, "s").select(*ITEM, "best_rank", "fused_rank")


@query(f"WITH {SQL_C}, y AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS r1, row_number() OVER (PARTITION BY question_id ORDER BY (event_id * 7) % 97 DESC, source_pts, candidate_index) AS r2 FROM c) SELECT question_id, candidate_index, round(1.0::DOUBLE / (r1 * r2), 9) AS fused FROM y")
def rank_product(spark, sf):
    c = candidates(spark, sf).withColumn("late", F.pmod(F.col("event_id") * 7, F.lit(97)))
    return ranking.rank_product(c, QUESTION, "score", "late").select(*ITEM, F.round("fused", 9).alias("fused"))


@query("WITH u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, row_number() OVER (ORDER BY sha256('2027/train/' || user_id)) AS place FROM u) SELECT user_id, CASE WHEN place <= 120 THEN place END AS place, CASE WHEN place <= 80 THEN 'train' WHEN place <= 120 THEN 'validation' ELSE 'rest' END AS part FROM p")
def hash_split(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    return ranking.hash_split(u, "user_id", F.concat(F.lit("2027/train/"), F.col("user_id").cast("string")), {"train": 80, "validation": 40}).select("user_id", "place", "part")


@query("WITH u AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, (row_number() OVER (ORDER BY sha256('2027/' || source)) - 1) % 5 AS fold FROM u) SELECT doc_id, source, fold FROM documents JOIN p USING (source)")
def group_kfold(spark, sf):
    return ranking.group_kfold(table(spark, sf, "documents").select("doc_id", "source"), "source", 5, F.concat(F.lit("2027/"), F.col("source")))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('2027:' || doc_id)) AS o FROM documents), p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('2027:' || doc_id)) AS place FROM f WHERE o = 1) SELECT doc_id, lang, place, row_number() OVER (ORDER BY place, lang) AS ordinal FROM p WHERE place <= 10")
def stratified_first_n(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("h", F.sha2(F.concat(F.lit("2027:"), F.col("doc_id").cast("string")), 256))
    once = d.withColumn("o", F.row_number().over(Window.partitionBy("lang", "source").orderBy("h"))).where("o = 1")
    return ranking.interleaved(ranking.first_per_stratum(once, "lang", 10, [F.col("h")]), "lang").select("doc_id", "lang", "place", "ordinal")


@query(f"WITH {SQL_S} SELECT question_id, core_id, count(*) AS seeds, min(source_pts) AS first_pts, max(source_pts) AS last_pts FROM k GROUP BY question_id, core_id")
def gap_sessions(spark, sf):
    return cores(candidates(spark, sf)).groupBy("question_id", "core_id").agg(F.count(F.lit(1)).alias("seeds"), F.min("source_pts").alias("first_pts"), F.max("source_pts").alias("last_pts"))


@query(f'WITH {SQL_R} SELECT question_id, region_id, l AS "left", r AS "right", m, c, weight, refine FROM g')
def interval_islands(spark, sf):
    return regions(candidates(spark, sf))


_CELLS = f"""z AS (SELECT question_id, region_id, l, r,
  CASE WHEN lag(r) OVER w IS NULL THEN low ELSE ((lag(r) OVER w + l) // 2) // {HOUR} * {HOUR} + {HOUR} END AS cell_left,
  CASE WHEN lead(l) OVER w IS NULL THEN high ELSE ((r + lead(l) OVER w) // 2) // {HOUR} * {HOUR} END AS cell_right
  FROM g JOIN b USING (question_id) WINDOW w AS (PARTITION BY question_id ORDER BY l))"""


def _cells(c):
    return temporal.voronoi_cells(regions(c).join(bounds(c), QUESTION), QUESTION, HOUR, F.col("low"), F.col("high"))


@query(f"WITH {SQL_R}, {_CELLS} SELECT question_id, region_id, cell_left, cell_right FROM z")
def voronoi_cells(spark, sf):
    return _cells(candidates(spark, sf)).select("question_id", "region_id", "cell_left", "cell_right")


@query(f"WITH {SQL_C}, t AS (SELECT *, (source_pts - min(source_pts) OVER (PARTITION BY question_id)) // {6 * HOUR} AS k FROM c), f AS (SELECT question_id, k, min(source_pts) AS source_pts FROM t GROUP BY question_id, k) SELECT question_id, coalesce(lag(k) OVER (PARTITION BY question_id ORDER BY k), -1) + 1 AS target_index, source_pts FROM f")
def grid_asof(spark, sf):
    c = candidates(spark, sf).withColumn("start", F.min("source_pts").over(Window.partitionBy("question_id")))
    return temporal.grid_asof(c, QUESTION, "source_pts", F.col("start"), 0, 6 * HOUR, ["candidate_index"]).select("question_id", F.col("target_index").cast("long").alias("target_index"), "source_pts")


@query(f"WITH {SQL_S} SELECT c.question_id, c.candidate_index, s.candidate_index AS anchor_index FROM c ASOF LEFT JOIN s ON c.question_id = s.question_id AND c.source_pts >= s.source_pts")
def anchor_asof(spark, sf):
    c = candidates(spark, sf)
    s = ranking.top_k(c, QUESTION, 16).select("question_id", "source_pts", F.col("candidate_index").alias("anchor_index"))
    return temporal.backward_asof(c.select("question_id", "source_pts", "candidate_index"), s, QUESTION, "source_pts", ["anchor_index"]).select(*ITEM, "anchor_index")


@query(f"WITH {SQL_R} SELECT c.question_id, candidate_index, region_id FROM c JOIN g ON c.question_id = g.question_id AND source_pts BETWEEN l AND r")
def range_membership(spark, sf):
    c = candidates(spark, sf)
    return temporal.range_join(c, regions(c).select("question_id", "region_id", "left", "right"), QUESTION, "source_pts", 48 * HOUR).select(*ITEM, "region_id")


@query(f"WITH {SQL_R}, {_CELLS} SELECT c.question_id, candidate_index, region_id FROM c JOIN z ON c.question_id = z.question_id AND source_pts >= cell_left AND source_pts <= cell_right")
def bucket_membership(spark, sf):
    c = candidates(spark, sf)
    cells = _cells(c).select("question_id", "region_id", F.col("cell_left").alias("left"), F.col("cell_right").alias("right"))
    return temporal.range_join(c, cells, QUESTION, "source_pts", 96 * HOUR).select(*ITEM, "region_id")


@query(f"WITH {SQL_C} SELECT o.question_id, candidate_index FROM c o WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c) WHERE rk <= 3) t WHERE t.question_id = o.question_id AND abs(t.source_pts - o.source_pts) <= {6 * HOUR})")
def outside_windows(spark, sf):
    c = candidates(spark, sf)
    spans = ranking.top_k(c, QUESTION, 3).select("question_id", (F.col("source_pts") - 6 * HOUR).alias("left"), (F.col("source_pts") + 6 * HOUR).alias("right"))
    return temporal.range_join(c, spans, QUESTION, "source_pts", 24 * HOUR, how="left_anti").select(*ITEM)


@query(f"""WITH {SQL_R}, y AS (SELECT question_id, candidate_index AS b_id, source_pts - {6 * HOUR} AS l, source_pts + {6 * HOUR} AS r FROM s WHERE rk <= 8),
p AS (SELECT g.question_id, region_id, b_id, least(g.r, y.r) - greatest(g.l, y.l) AS overlap FROM g JOIN y ON g.question_id = y.question_id AND greatest(g.l, y.l) <= least(g.r, y.r)),
d AS (SELECT *, count(*) OVER (PARTITION BY question_id, region_id) AS a_degree, count(*) OVER (PARTITION BY question_id, b_id) AS b_degree FROM p)
SELECT question_id, region_id, b_id, overlap, CASE WHEN a_degree = 1 AND b_degree = 1 THEN 'one_to_one' WHEN b_degree = 1 THEN 'split' WHEN a_degree = 1 THEN 'merge' ELSE 'many_to_many' END AS kind FROM d""")
def interval_overlap(spark, sf):
    c = candidates(spark, sf)
    b = ranking.top_k(c, QUESTION, 8).select("question_id", F.col("candidate_index").alias("b_id"), (F.col("source_pts") - 6 * HOUR).alias("left"), (F.col("source_pts") + 6 * HOUR).alias("right"))
    return temporal.overlap_join(regions(c), b, QUESTION, 48 * HOUR, "region_id", "b_id").select("question_id", "region_id", "b_id", "overlap", "kind")


@query(f"WITH {SQL_R} SELECT question_id, candidate_index, arg_min(core_id, (d, l, core_id)) AS core_id, min(d) AS distance FROM (SELECT c.question_id, candidate_index, core_id, l, greatest(l - source_pts, 0, source_pts - r) AS d FROM c JOIN w ON c.question_id = w.question_id) GROUP BY question_id, candidate_index")
def nearest_core(spark, sf):
    c = candidates(spark, sf)
    return temporal.nearest_interval(c, windows(c), QUESTION, "source_pts", ["candidate_index"], "core_id")


@query(f"WITH {SQL_S} SELECT c.question_id, c.candidate_index, min(abs(c.source_pts - s.source_pts)) AS distance FROM c JOIN s ON c.question_id = s.question_id GROUP BY c.question_id, c.candidate_index")
def nearest_time(spark, sf):
    c = candidates(spark, sf)
    return temporal.nearest_in_time(c, ranking.top_k(c, QUESTION, 16), QUESTION, "source_pts", "candidate_index").select(*ITEM, "distance")


@query(f"""WITH {SQL_R}, n AS (SELECT question_id, candidate_index, source_pts, arg_min(region_id, (d, l, region_id)) AS region_id, min(d) AS d FROM (SELECT c.question_id, candidate_index, source_pts, region_id, l, greatest(l - source_pts, 0, source_pts - r) AS d FROM c JOIN g ON c.question_id = g.question_id) GROUP BY ALL),
h AS (SELECT question_id, region_id, l, r, lag(r) OVER (PARTITION BY question_id ORDER BY l) AS p, lead(l) OVER (PARTITION BY question_id ORDER BY l) AS q FROM g)
SELECT n.question_id, candidate_index, n.region_id, round(coalesce(CASE WHEN source_pts < l AND l > p THEN 1 - d / (l - p)::DOUBLE WHEN source_pts > r AND q > r THEN 1 - d / (q - r)::DOUBLE END, 1.0), 9) AS weight FROM n JOIN h ON n.question_id = h.question_id AND n.region_id = h.region_id""")
def gap_ownership(spark, sf):
    c = candidates(spark, sf)
    return temporal.gap_weight(c.select("question_id", "candidate_index", "source_pts"), regions(c), QUESTION, "source_pts", ["candidate_index"], "region_id").select(*ITEM, "region_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {SQL_C} SELECT a.question_id, a.candidate_index, round(max(b.score * exp(-abs(a.source_pts - b.source_pts) / {24.0 * HOUR})), 6) AS support FROM c a JOIN c b ON a.question_id = b.question_id GROUP BY a.question_id, a.candidate_index")
def decay_support(spark, sf):
    c = candidates(spark, sf).withColumn("t", (F.col("source_pts") - F.min("source_pts").over(Window.partitionBy("question_id"))).cast("double"))
    return temporal.decay_support(c, QUESTION, "t", "score", 24.0 * HOUR).select(*ITEM, F.round("support", 6).alias("support"))


@query(f"WITH {SQL_C}, r AS (SELECT question_id, event_type, candidate_index, candidate_index - row_number() OVER (PARTITION BY question_id, event_type ORDER BY candidate_index) AS run FROM c) SELECT question_id, event_type, min(candidate_index) AS island, max(candidate_index) AS island_end, count(*) AS size FROM r GROUP BY question_id, event_type, run")
def field_islands(spark, sf):
    return temporal.field_islands(candidates(spark, sf), QUESTION, "event_type", "candidate_index")


@query(f"""WITH {SQL_R} SELECT question_id, region_id, k * {3 * HOUR} + {HOUR} AS target FROM (SELECT question_id, region_id, unnest(range(CAST(ceil((l - {HOUR}) / {3.0 * HOUR}) AS BIGINT), CAST(floor((r - {HOUR}) / {3.0 * HOUR}) AS BIGINT) + 1)) AS k FROM g WHERE refine) WHERE (k * {3 * HOUR} + {HOUR}) % {6 * HOUR} <> 0""")
def refinement_grid(spark, sf):
    r = regions(candidates(spark, sf)).where("refine")
    return temporal.refinement_targets(r, QUESTION, 3 * HOUR, HOUR, 6 * HOUR).select("question_id", "region_id", "target")


@query(f"""WITH {SQL_S}, x AS (SELECT c.*, s.candidate_index IS NOT NULL AS taken FROM c LEFT JOIN s ON c.question_id = s.question_id AND c.candidate_index = s.candidate_index),
y AS (SELECT *, lead(source_pts) OVER o AS np, lead(taken) OVER o AS nt, lag(taken) OVER o AS bt, min(CASE WHEN taken THEN source_pts END) OVER (PARTITION BY question_id ORDER BY source_pts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sp FROM x WINDOW o AS (PARTITION BY question_id ORDER BY source_pts))
SELECT question_id, candidate_index, CASE WHEN np IS NULL THEN 'no_successor' WHEN sp IS NULL THEN 'no_next_slot' WHEN nt THEN 'successor_selected' WHEN coalesce(bt, false) THEN 'predecessor_selected' WHEN np - source_pts > {12 * HOUR} THEN 'too_far' ELSE 'proposed' END AS reason FROM y WHERE taken""")
def neighbor_repair(spark, sf):
    c = candidates(spark, sf)
    taken = ranking.stable_rank(c, QUESTION).withColumn("taken", F.col("rank") <= 16)
    return temporal.neighbour_repairs(taken, QUESTION, "source_pts", "taken", 12 * HOUR).select(*ITEM, "reason")


_W = "z AS (SELECT stratum, n, k, k / n::DOUBLE AS p FROM (SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, count(*) FILTER (WHERE a) AS k FROM t GROUP BY GROUPING SETS ((stratum), ())))"
_Z = statistics.Z


@query(f"WITH {SQL_T}, {_W} SELECT stratum, n, k, p AS accuracy, round(greatest((p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 0), 9) AS low, round(least((p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 1), 9) AS high FROM z")
def wilson_by_stratum(spark, sf):
    out = statistics.accuracy(results(spark, sf), "stratum", "a")
    return out.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


@query(f"WITH {SQL_T}, x AS (SELECT stratum, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS m FROM t GROUP BY stratum) SELECT count(*) AS tasks, round(100 * avg(m), 9) AS macro FROM x HAVING count(*) = 4")
def macro_avg(spark, sf):
    return statistics.macro_average(results(spark, sf), "stratum", 4, "a").withColumn("macro", F.round("macro", 9))


@query(f"WITH {SQL_T} SELECT stratum, count(*) AS n, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_left, count(*) FILTER (WHERE b AND NOT a) AS n_right, count(*) FILTER (WHERE NOT a AND NOT b) AS n_none, 100.0 * (count(*) FILTER (WHERE a AND NOT b) - count(*) FILTER (WHERE b AND NOT a)) / count(*) AS difference FROM t GROUP BY stratum")
def paired_cells(spark, sf):
    t = results(spark, sf)
    pairs = statistics.paired(t.select("doc_id", "stratum", F.col("a").alias("correct")), t.select("doc_id", F.col("b").alias("correct")), "doc_id")
    return statistics.paired_difference(pairs, ["stratum"])


@query(f"WITH {SQL_T} SELECT doc_id, CASE WHEN a THEN '1' ELSE '0' END || CASE WHEN b THEN '1' ELSE '0' END AS pattern FROM t")
def failure_patterns(spark, sf):
    t = results(spark, sf)
    long = t.select("doc_id", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("profile", "correct"))
    return statistics.patterns(long, "doc_id", "profile", ["a", "b"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def distribution(spark, sf):
    out = statistics.distribution(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p95")), "min", "max")


@query(f"WITH {SQL_S}, h AS (SELECT question_id, least(31, CAST(floor((source_pts - low) / greatest(high - low, 1)::DOUBLE * 32) AS BIGINT)) AS bin, count(*) AS n FROM s JOIN b USING (question_id) GROUP BY ALL), p AS (SELECT question_id, n / (sum(n) OVER (PARTITION BY question_id))::DOUBLE AS p FROM h) SELECT question_id, count(*) AS bins, round(-sum(p * ln(p)) / ln(32), 6) + 0.0 AS entropy FROM p GROUP BY question_id")
def bin_entropy(spark, sf):
    c = candidates(spark, sf)
    s = ranking.top_k(c, QUESTION, 16).join(bounds(c), QUESTION)
    out = statistics.histogram_entropy(s, QUESTION, (F.col("source_pts") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1)))
    return out.select("question_id", "bins", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query(f"WITH {SQL_V}, x AS (SELECT region, list_dot_product(e, lag(e) OVER w) / (n * lag(n) OVER w) AS c FROM v WINDOW w AS (PARTITION BY region ORDER BY vec_id)), y AS (SELECT region, 1 - least(greatest(c, 0), 1) AS d FROM x WHERE c IS NOT NULL) SELECT region, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90 FROM y GROUP BY region")
def adjacent_change(spark, sf):
    out = statistics.adjacent_change(vectors(spark, sf), ["region"], "vec_id", "embedding")
    return out.select("region", "n", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


_PAIRS = f"WITH {SQL_V}, p AS (SELECT a.region, a.vec_id AS a, b.vec_id AS b, a.score AS sa, b.score AS sb, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM v a JOIN v b ON a.region = b.region"


@query(_PAIRS + " AND a.vec_id < b.vec_id) SELECT region, count(*) AS pairs, round(quantile_cont(c, 0), 6) AS q0, round(quantile_cont(c, 0.1), 6) AS q10, round(quantile_cont(c, 0.5), 6) AS q50, round(quantile_cont(c, 0.9), 6) AS q90, round(quantile_cont(c, 1), 6) AS q100 FROM p GROUP BY region")
def pairwise_cosine_quantiles(spark, sf):
    out = statistics.pairwise_cosine(vectors(spark, sf), ["region"], "vec_id", "embedding")
    return out.select("region", "pairs", *(F.round(c, 6).alias(c) for c in ("q0", "q10", "q50", "q90", "q100")))


def _pairs(v, distinct=True):
    a, b = (v.select("region", F.col("vec_id").alias(k), F.col("embedding").alias(f"v{k}"), F.col("score").alias(f"s{k}")) for k in "ab")
    p = a.join(b, "region").withColumn("c", cosine(F.col("va"), F.col("vb")))
    return p.where("a <> b") if distinct else p


@query(_PAIRS + " AND a.vec_id <> b.vec_id) SELECT region, a AS vec_id, round(greatest(max(least(greatest(c, 0), 1)), 0), 6) AS nearest FROM p GROUP BY region, a")
def max_same_segment_cosine(spark, sf):
    return _pairs(vectors(spark, sf)).groupBy("region", F.col("a").alias("vec_id")).agg(F.round(F.max(clipped(F.col("c"))), 6).alias("nearest"))


_SEEDS = "s AS (SELECT region, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, vec_id) AS rk FROM v) WHERE rk <= 8)"


@query(f"WITH {SQL_V}, {_SEEDS}, m AS (SELECT region, max(score) AS top FROM s GROUP BY region) SELECT x.region, x.vec_id, round(max(CASE WHEN top > 0 THEN s.score / top ELSE 1 END * least(greatest(list_dot_product(x.e, y.e) / (x.n * y.n), 0), 1)), 6) AS support FROM v x JOIN s ON x.region = s.region JOIN v y ON y.vec_id = s.vec_id JOIN m ON m.region = x.region GROUP BY x.region, x.vec_id")
def seed_support(spark, sf):
    v = vectors(spark, sf)
    s = ranking.top_k(v, ["region"], 8, "score", ["vec_id"]).select("region", F.col("embedding").alias("e2"), F.col("score").alias("r"), F.max("score").over(Window.partitionBy("region")).alias("top"))
    w = F.when(F.col("top") > 0, F.col("r") / F.col("top")).otherwise(1.0)
    return v.join(s, "region").groupBy("region", "vec_id").agg(F.round(F.max(w * clipped(cosine(F.col("embedding"), F.col("e2")))), 6).alias("support"))


@query(f"WITH {SQL_V}, {_SEEDS}, o AS (SELECT s.region, s.vec_id, row_number() OVER (PARTITION BY s.region ORDER BY s.vec_id) AS step FROM s), x AS (SELECT r.region, r.vec_id, step, max(least(greatest(list_dot_product(r.e, y.e) / (r.n * y.n), 0), 1)) OVER (PARTITION BY r.vec_id ORDER BY step) AS covered FROM v r JOIN o ON r.region = o.region JOIN v y ON y.vec_id = o.vec_id) SELECT region, step, round(avg(covered), 6) AS coverage FROM x GROUP BY region, step")
def coverage_curve(spark, sf):
    v = vectors(spark, sf)
    s = ranking.top_k(v, ["region"], 8, "score", ["vec_id"]).select("region", F.col("embedding").alias("e2"), "step")
    sim = v.join(s, "region").withColumn("covered", F.max(clipped(cosine(F.col("embedding"), F.col("e2")))).over(Window.partitionBy("vec_id").orderBy("step")))
    return sim.groupBy("region", "step").agg(F.round(F.avg("covered"), 6).alias("coverage"))


@query(f"WITH {SQL_V}, {_SEEDS}, x AS (SELECT r.region, r.vec_id AS ref, s.vec_id, least(greatest(list_dot_product(r.e, y.e) / (r.n * y.n), 0), 1) AS c FROM v r JOIN s ON r.region = s.region JOIN v y ON y.vec_id = s.vec_id), y AS (SELECT *, row_number() OVER w AS k, lead(c) OVER w AS second, count(*) OVER (PARTITION BY region, vec_id) AS refs FROM x WINDOW w AS (PARTITION BY ref ORDER BY c DESC, vec_id)) SELECT region, vec_id, round(sum(CASE WHEN k = 1 THEN c - coalesce(second, 0) ELSE 0 END) / max(refs), 6) AS loss FROM y GROUP BY region, vec_id")
def removal_cost(spark, sf):
    v = vectors(spark, sf)
    s = ranking.top_k(v, ["region"], 8, "score", ["vec_id"]).select("region", F.col("vec_id").alias("taken"), F.col("embedding").alias("e2"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("c"), "taken")
    x = v.join(s, "region").withColumn("c", clipped(cosine(F.col("embedding"), F.col("e2"))))
    x = x.withColumn("k", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("c").over(w), F.lit(0.0)))
    return x.groupBy("region", F.col("taken").alias("vec_id")).agg(F.round(F.sum(F.when(F.col("k") == 1, F.col("c") - F.col("second")).otherwise(0.0)) / F.count(F.lit(1)), 6).alias("loss"))


@query("WITH d AS (SELECT doc_id // 200 AS question, n_chars, quality FROM documents JOIN labels USING (doc_id)) SELECT a.question, count(*) AS pairs, round(avg(CASE WHEN abs(a.n_chars - b.n_chars) <= 1e-8 THEN 0.5 WHEN a.n_chars > b.n_chars THEN 1.0 ELSE 0.0 END), 6) AS preference FROM d a JOIN d b ON a.question = b.question AND a.quality = 1 AND b.quality = 0 GROUP BY a.question")
def preference_accuracy(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.floor(F.col("doc_id") / 200).alias("question"), F.col("quality"), F.col("n_chars").cast("double").alias("score"))
    return statistics.preference(d, "question", "quality", "score").withColumn("preference", F.round("preference", 6))


_TOK = "list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))"


@query(f"WITH x AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), y AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM x) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, p))) = 0 THEN 1.0 ELSE len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p)))::DOUBLE END, 9) AS jaccard FROM y WHERE p IS NOT NULL")
def token_jaccard(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w"))
    rows = c.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("p")), 9).alias("jaccard"))


@query("SELECT p.page_id, round(levenshtein(p.url, b.url) / greatest(length(p.url), length(b.url))::DOUBLE, 9) AS change FROM pages p JOIN pages b ON p.page_id = b.page_id + 1")
def edit_change(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    b = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("p"))
    return p.join(b, "page_id").select("page_id", F.round(tx.edit_change(F.col("url"), F.col("p")), 9).alias("change"))


@query("SELECT event_id, CASE WHEN event_id % 9 < 6 AND user_id % 7 < 5 THEN substr('ABCDEFG', user_id % 7 + 1, 1) END AS answer FROM events")
def answer_parse(spark, sf):
    """Answers in nine forms, of which three are none: a letter with a word after it, two letters, and a letter with a comma."""
    e = table(spark, sf, "events")
    letter = F.substr(F.lit("ABCDEFG"), (F.col("user_id") % 7 + 1).cast("int"), F.lit(1))
    forms = [letter, F.concat(letter, F.lit(".")), F.concat(F.lit(" ("), letter, F.lit(") ")), F.concat(F.lit("Answer: "), F.lower(letter)), F.concat(F.lit("ANSWER :("), letter, F.lit(").")), F.lower(letter), F.concat(letter, F.lit(" "), F.col("event_type")), F.concat(letter, letter), F.concat(letter, F.lit(","))]
    said = forms[0]
    for k, x in enumerate(forms):
        said = F.when(F.col("event_id") % 9 == k, x).otherwise(said)
    return e.select("event_id", tx.parse_answer(said).alias("answer"))


@query(f"WITH {SQL_C} SELECT event_type, round(sum(CASE WHEN score > 0 AND score < 1 THEN greatest(0, ln(score / (1 - score)) - ln(0.5 / 0.5)) ELSE 0 END), 4) AS gain FROM c WHERE score > 0 AND score < 1 GROUP BY event_type")
def logit_gain(spark, sf):
    c = candidates(spark, sf).where("score > 0 AND score < 1")
    return c.groupBy("event_type").agg(F.round(F.sum(tx.logit_gain(F.col("score"), F.lit(0.5))), 4).alias("gain"))


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT lang, list(n / t::DOUBLE ORDER BY source) AS p FROM (SELECT l.lang, s.source, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY l.lang) AS t FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN n ON n.lang = l.lang AND n.source = s.source) GROUP BY lang)
SELECT a.lang AS a, b.lang AS b, round(least(greatest(list_sum(list_transform(list_zip(a.p, b.p), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * ln(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)) / ln(2), 0), 1), 6) AS js FROM p a JOIN p b ON a.lang < b.lang""")
def js_divergence(spark, sf):
    return statistics.group_divergences(table(spark, sf, "documents"), "lang", "source").select("a", "b", F.round("js", 6).alias("js"))


@query(f"WITH {SQL_S}, u AS (SELECT * FROM c WHERE candidate_index % 5 = 0), x AS (SELECT question_id, candidate_index FROM s), y AS (SELECT question_id, candidate_index FROM u) SELECT question_id, count(*) FILTER (WHERE a = 2) AS common, count(*) AS \"union\", count(*) FILTER (WHERE a = 2) / count(*)::DOUBLE AS jaccard FROM (SELECT question_id, candidate_index, count(*) AS a FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL) GROUP BY question_id")
def selection_overlap(spark, sf):
    c = candidates(spark, sf)
    return sets.jaccard_overlap(ranking.top_k(c, QUESTION, 16), c.where("candidate_index % 5 = 0"), QUESTION, ["candidate_index"])


@query(f"WITH {SQL_S}, u AS (SELECT * FROM c WHERE candidate_index % 5 = 0) SELECT question_id, candidate_index, CASE WHEN x THEN 'removed' ELSE 'added' END AS change FROM (SELECT coalesce(s.question_id, u.question_id) AS question_id, coalesce(s.candidate_index, u.candidate_index) AS candidate_index, s.question_id IS NOT NULL AS x, u.question_id IS NOT NULL AS y FROM s FULL JOIN u ON s.question_id = u.question_id AND s.candidate_index = u.candidate_index) WHERE x <> y")
def set_diff(spark, sf):
    c = candidates(spark, sf)
    return sets.added_removed(ranking.top_k(c, QUESTION, 16), c.where("candidate_index % 5 = 0"), QUESTION, ["candidate_index"])


@query(f"WITH {SQL_S}, u AS (SELECT * FROM c WHERE candidate_index % 5 = 0), x AS (SELECT question_id, source_pts, 0.5 / count(*) OVER (PARTITION BY question_id) AS m FROM s UNION ALL SELECT question_id, source_pts, 0.5 / count(*) OVER (PARTITION BY question_id) FROM u), y AS (SELECT question_id, source_pts, sum(m) AS mass FROM x GROUP BY ALL) SELECT question_id, source_pts, round(mass, 9) AS mass, round(sum(mass) OVER (PARTITION BY question_id ORDER BY source_pts) - mass / 2, 9) AS centre FROM y")
def mass_union(spark, sf):
    c = candidates(spark, sf)
    out = sets.mass_union(ranking.top_k(c, QUESTION, 16).select("question_id", "source_pts"), c.where("candidate_index % 5 = 0").select("question_id", "source_pts"), QUESTION, ["source_pts"])
    return out.select("question_id", "source_pts", F.round("mass", 9).alias("mass"), F.round("centre", 9).alias("centre"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents")
def alias_resolve(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"))
    return sets.canonical(d, "content", "doc_id").select("doc_id", "canonical")


@query("SELECT event_type, props, min(user_id) AS representative, count(DISTINCT user_id) AS users FROM events GROUP BY event_type, props")
def input_dedup(spark, sf):
    e = table(spark, sf, "events").select("event_type", "props", "user_id")
    return sets.shared_inputs(e, "event_type", "props", "user_id", []).select("event_type", "props", "representative", F.size("methods").cast("long").alias("users"))


@query(f"WITH {SQL_C}, x AS (SELECT question_id, candidate_index, CASE WHEN candidate_index % 7 = 0 THEN -1 ELSE candidate_index END AS i, CASE WHEN candidate_index % 11 = 0 THEN 1.5 ELSE score END AS s FROM c) SELECT question_id, i AS candidate_index, unnest(list_filter([CASE WHEN i <> candidate_index THEN 'index' END, CASE WHEN s > 1 THEN 'score' END], lambda z: z IS NOT NULL)) AS rule FROM x")
def dq_violations(spark, sf):
    c = candidates(spark, sf)
    bad = c.withColumn("score", F.when(F.col("candidate_index") % 11 == 0, 1.5).otherwise(F.col("score")))
    w = Window.partitionBy("question_id").orderBy("source_pts", "event_id")
    rows = bad.withColumn("_place", F.row_number().over(w) - 1).withColumn("candidate_index", F.when(F.col("candidate_index") % 7 == 0, -1).otherwise(F.col("candidate_index")))
    return contracts.violations(rows, ["question_id", "candidate_index"], {"index": F.col("candidate_index") == F.col("_place"), "score": (F.col("score") >= 0) & (F.col("score") <= 1)})


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'row' END, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 'o_totalprice' END], lambda z: z IS NOT NULL)) AS field FROM orders")
def result_diff(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    n = o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return sets.diff(o, n, ["o_orderkey"], ["o_custkey"], ["o_totalprice"])


@query("SELECT doc_id, source, doc_id % 10 = 0 AS conflict FROM (SELECT doc_id, 'a' AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0)")
def provenance_union(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sets.disjoint_union(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 OR doc_id % 10 = 0"), ["doc_id"]).select("doc_id", "source", "conflict")


@query("WITH p AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t FROM orders) SELECT o_custkey, count(*) AS sessions, max(n) AS longest FROM (SELECT o_custkey, s, count(*) AS n FROM (SELECT o_custkey, sum(CASE WHEN t - q > 7776000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS q FROM p)) GROUP BY ALL) GROUP BY o_custkey")
def order_sessions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    s = temporal.gap_sessions(o, ["o_custkey"], "t", 90 * 24 * HOUR, ["o_orderkey"]).groupBy("o_custkey", "core_id").count()
    return s.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("sessions"), F.max("count").alias("longest"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, sf):
    from ..streaming.events import window_counts as counts

    return counts(table(spark, sf, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query(_PAIRS + " AND a.vec_id < b.vec_id), x AS (SELECT *, max(c) OVER (PARTITION BY region, a) AS ma, max(c) OVER (PARTITION BY region, b) AS mb FROM p WHERE c > 0) SELECT region, a, b, round(c, 6) AS c FROM x WHERE c = ma AND c = mb")
def mutual_nearest(spark, sf):
    p = _pairs(vectors(spark, sf)).where("a < b").select("region", "a", "b", "c")
    return matching.mutual_best(p, ["region"], "a", "b", "c").select("region", "a", "b", F.round("c", 6).alias("c"))


@query(f"WITH {SQL_V}, p AS (SELECT a.region, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS distance FROM v a JOIN v b ON a.region = b.region AND a.vec_id < b.vec_id) SELECT region, a, b, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 22")
def near_dup_hamming(spark, sf):
    v = vectors(spark, sf).select("region", "vec_id", matching.sign_hash(F.col("embedding")).alias("h"))
    return matching.hamming_pairs(v, ["region"], "vec_id", "h", 22)


@query(f"WITH x AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), y AS (SELECT conv_id, turn, w, coalesce(lag(w) OVER o, []) AS p, coalesce(lead(w) OVER o, []) AS q FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, array_to_string(list_sort(list_intersect(w, list_concat(p, q))), ' ') AS confirmed FROM y")
def token_confirm(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w"))
    return matching.confirmed_tokens(c, ["conv_id"], "turn", "w").select("conv_id", "turn", F.array_join("confirmed", " ").alias("confirmed"))


@query(f"""WITH {SQL_R}, m AS (SELECT c.question_id, c.candidate_index, c.score, c.source_pts, region_id, weight FROM c LEFT JOIN g ON c.question_id = g.question_id AND source_pts BETWEEN l AND r),
x AS (SELECT *, row_number() OVER (PARTITION BY question_id, region_id ORDER BY score DESC, source_pts, candidate_index) AS k FROM m)
SELECT question_id, candidate_index, CASE WHEN region_id IS NULL THEN 'outside_legal_pool' WHEN k > 5 THEN 'outside_prefix' WHEN k <= weight THEN 'selected' WHEN k <= weight + 2 THEN 'quota_reachable' ELSE 'beyond_feasible_quota' END AS state FROM x""")
def witness_path(spark, sf):
    c = candidates(spark, sf)
    m = temporal.range_join(c, regions(c).select("question_id", "region_id", "left", "right", "weight"), QUESTION, "source_pts", 48 * HOUR, how="left")
    k = F.row_number().over(Window.partitionBy("question_id", "region_id").orderBy(F.desc("score"), "source_pts", "candidate_index"))
    x = m.withColumn("k", F.when(k <= 5, k))
    return x.select(*ITEM, matching.witness_state(F.col("region_id").isNotNull(), F.col("k"), F.col("weight"), F.col("weight") + 2).alias("state"))


@query(f"WITH {SQL_S}, x AS (SELECT question_id, source_pts, low, high, coalesce(source_pts - lag(source_pts) OVER (PARTITION BY question_id ORDER BY source_pts), source_pts - low) AS g FROM s JOIN b USING (question_id)) SELECT question_id, count(DISTINCT CASE WHEN high > low THEN least(31, CAST(floor((source_pts - low) / (high - low)::DOUBLE * 32) AS BIGINT)) ELSE 0 END) AS bins, greatest(max(g), min(high - source_pts)) AS max_gap, max(source_pts) - min(source_pts) AS span FROM x GROUP BY question_id")
def selection_spread(spark, sf):
    c = candidates(spark, sf)
    s = ranking.top_k(c, QUESTION, 16).join(bounds(c), QUESTION)
    return matching.spread_pairs(s, QUESTION, "source_pts", 32, F.col("low"), F.col("high"))


@query(f"WITH {SQL_T} SELECT CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, CASE WHEN grouping(cluster) = 1 THEN 'all' ELSE cluster END AS cluster, count(*) AS n, count(*) FILTER (WHERE a) AS right_a, count(*) FILTER (WHERE b) AS right_b FROM t GROUP BY GROUPING SETS ((stratum), (cluster), (stratum, cluster))")
def grouped_profile(spark, sf):
    measures = {"n": F.count(F.lit(1)), "right_a": F.count_if(F.col("a")), "right_b": F.count_if(F.col("b"))}
    return reports.profile(results(spark, sf), [["stratum"], ["cluster"], ["stratum", "cluster"]], measures)


@query(f"WITH {SQL_T} SELECT stratum, count(*) AS n, count(*) FILTER (WHERE NOT a AND NOT b) AS common, count(*) FILTER (WHERE NOT a) AS wrong_a, count(*) FILTER (WHERE NOT b) AS wrong_b FROM t GROUP BY stratum")
def common_failures(spark, sf):
    return reports.common_failures(results(spark, sf), ["a", "b"], "stratum")


@query(f"WITH {SQL_S}, u AS (SELECT question_id, candidate_index FROM c WHERE candidate_index % 2 = 0), e AS (SELECT s.question_id, avg(CASE WHEN u.candidate_index IS NULL THEN 0.0 ELSE 1.0 END) AS retained FROM s LEFT JOIN u ON s.question_id = u.question_id AND s.candidate_index = u.candidate_index GROUP BY s.question_id) SELECT question_id, round(retained, 9) AS retained, round(avg(retained) OVER (), 9) AS macro FROM e")
def retention(spark, sf):
    c = candidates(spark, sf)
    out = reports.retention(c.where("candidate_index % 2 = 0"), ranking.top_k(c, QUESTION, 16), QUESTION, "candidate_index")
    return out.select("question_id", F.round("retained", 9).alias("retained"), F.round("macro", 9).alias("macro"))


@query(f"WITH {SQL_C} SELECT question_id, candidate_index AS original_index, row_number() OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) - 1 AS candidate_index FROM c WHERE event_type <> 'error'")
def exclusion_reindex(spark, sf):
    c = candidates(spark, sf)
    return pools.exclude(c, c.where("event_type = 'error'"), QUESTION).select("question_id", "original_index", "candidate_index")


@query(f"""WITH {SQL_R}, t AS (SELECT question_id, r, unnest(range(l + {HOUR}, r + 1, {6 * HOUR})) AS target FROM g),
n AS (SELECT t.question_id, target, t.r, min(source_pts) AS source FROM t LEFT JOIN c ON c.question_id = t.question_id AND source_pts >= target GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY target) AS nth FROM n)
SELECT m.question_id, target, source, CASE WHEN source IS NULL THEN 'no_source' WHEN source > m.r THEN 'outside_window' WHEN s.source_pts IS NOT NULL OR nth > 1 THEN 'duplicate_source' ELSE 'added' END AS status FROM m LEFT JOIN s ON s.question_id = m.question_id AND s.source_pts = source""")
def fine_pool(spark, sf):
    c = candidates(spark, sf)
    r = regions(c)
    targets = r.withColumn("target", F.explode(F.sequence(F.col("left") + HOUR, F.greatest("right", F.col("left") + HOUR), F.lit(6 * HOUR)))).where("target <= right").select("question_id", "target", "right")
    _, status = pools.fine_pool(ranking.top_k(c, QUESTION, 16), targets, c, QUESTION, "source_pts")
    return status


def _selected(variant):
    def run(spark, sf):
        v = vectors(spark, sf).withColumn("weight", F.lit(1.0) + F.col("region") % 3)
        return selection.select_by_regions(v, "question", 32, variant, "region", "score", "embedding", "vec_id")

    run.__name__ = f"select_{variant}"
    return run


for _variant in ("coverage", "relevance_coverage", "equal_coverage", "optional_coverage", "facility", "two_pass", *selection.COMPETITIONS):
    query(selector_sql.SELECT[_variant])(_selected(_variant))


def kernel(name, schema, sql=None):
    """A kernel over each region's vectors: rows are its choices."""

    def register(f):
        def run(spark, sf):
            def of_region(rows):
                x = selection.unit_rows([list(v) for v in rows["embedding"]])
                return pd.DataFrame([(int(rows["region"].iloc[0]), *r) for r in f(rows, x)], columns=[c.split()[0] for c in schema.split(", ")])

            return selection.grouped(vectors(spark, sf), ["region"], of_region, schema, ["vec_id"])

        run.__name__ = name
        query(sql)(run)
        return f

    return register


@kernel("greedy_mmr", "region long, step int, vec_id long", selector_sql.MMR)
def _mmr(rows, x):
    return [(k + 1, int(rows["vec_id"].iloc[i])) for k, i in enumerate(selection.marginal_relevance(rows["score"].to_numpy(), x @ x.T, 8))]


@kernel("sb_compete", "region long, step int, vec_id long", selector_sql.SB)
def _sb(rows, x):
    segment = rows["vec_id"].to_numpy() % 4
    return [(k + 1, int(rows["vec_id"].iloc[i])) for k, i in enumerate(selection.segment_competition(segment, rows["score"].to_numpy(), selection.clipped_cosines(x), min(8, len(rows))))]


@kernel("wavelet_segments", "region long, boundary int")
def _wavelet(rows, x):
    return [(int(b),) for b in selection.wavelet_segments(rows["score"].to_numpy())]
