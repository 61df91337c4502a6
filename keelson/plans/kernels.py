"""Queries of the kernels that act on one region or question, with SQL that shares nothing with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.vectors import clipped, cosine, recovered_projection, redundancy
from ..operators import matching, pools, ranking, reports, selection, sets, temporal
from . import selector_sql as S
from .queries import kernel
from .registry import query
from .views import GAP, HOUR, QUESTION, RADIUS, SQL_C, SQL_R, SQL_V, bounds, candidates, cores, regions, table, vectors, windows

CHOICE = "region long, step int, vec_id long"


def _tokens(ids) -> list[frozenset[int]]:
    return [frozenset() if i % 7 == 0 else frozenset((int(i % 3), int(10 + i % 5))) for i in ids]


def _steps(rows, order):
    return [(k + 1, int(rows["vec_id"].iloc[i])) for k, i in enumerate(order)]


def _whole(rows) -> selection.Region:
    every = np.arange(len(rows))
    return selection.Region(every, every, int(np.argmax(rows["score"].to_numpy())))


@kernel("visual_temporal_prefix", CHOICE, S.VISUAL_TEMPORAL)
def _visual_temporal(rows, x):
    sim = selection.visual_temporal(selection.clipped_cosines(x), rows["vec_id"].to_numpy(float), 40.0)
    return _steps(rows, selection.prefix(_whole(rows), rows["score"].to_numpy(), sim, 8))


@kernel("text_state_prefix", CHOICE, S.TEXT_STATE)
def _text_state(rows, x):
    sim = selection.text_state(selection.clipped_cosines(x), _tokens(rows["vec_id"]))
    return _steps(rows, selection.prefix(_whole(rows), rows["score"].to_numpy(), sim, 8))


@kernel("temporal_coverage_prefix", CHOICE, S.TEMPORAL_COVERAGE)
def _temporal_coverage(rows, x):
    return _steps(rows, selection.facility_prefix(_whole(rows), selection.stepped(selection.temporal_similarity(rows["vec_id"].to_numpy(float))), 8))


@kernel("literal_prefix", CHOICE, S.LITERAL)
def _literal(rows, x):
    return _steps(rows, selection.literal_prefix(_whole(rows), rows["score"].to_numpy(), selection.clipped_cosines(x), _tokens(rows["vec_id"]), 8))


@kernel("similarity_runs", "region long, vec_id long, run long", S.RUNS)
def _runs(rows, x):
    return list(zip(rows["vec_id"].tolist(), selection.similarity_runs(rows["vec_id"].to_numpy(float), x @ x.T, 30.0, 0.2).tolist(), strict=True))


@kernel("ordered_pairs", "region long, a long, b long", S.PAIRS)
def _pairs(rows, x):
    ids = rows["vec_id"].to_numpy()
    got = selection.ordered_pairs(range(len(ids)), {i: int(v // 100) for i, v in enumerate(ids)}, {i for i, v in enumerate(ids) if v % 3 == 0}, x @ x.T)
    return [(int(ids[a]), int(ids[b])) for a, b in got]


def _best(rows, n):
    return np.argsort(-rows["score"].to_numpy(), kind="stable")[:n].tolist()


@kernel("best_exchange", "region long, removed long, added long, gain double", S.EXCHANGE)
def _exchange(rows, x):
    held = _best(rows, 4)
    got = selection.best_exchange(np.arange(len(rows)), held, [i for i in range(len(rows)) if i not in held], selection.stepped(selection.clipped_cosines(x)))
    return [(int(rows["vec_id"].iloc[got[1]]), int(rows["vec_id"].iloc[got[2]]), round(got[0], 9))] if got else []


@kernel("low_loss_swap", "region long, vec_id long", S.LOW_LOSS)
def _low_loss(rows, x):
    held = _best(rows, 5)
    if len(held) < 2:
        return []  # a lone row has nothing to give way, and the SQL has no row of it
    add = held[4] if len(held) == 5 else None  # in a region of fewer, nothing comes in
    return [(int(rows["vec_id"].iloc[i]),) for i in selection.low_loss_swap(np.arange(len(rows)), held[:4], add, selection.clipped_cosines(x), {held[0]})]


@query(S.CORE_ANCHOR)
def select_core_anchor(spark, sf):
    v = vectors(spark, sf).withColumn("weight", F.lit(1.0) + F.col("region") % 3).withColumn("core", F.floor(F.col("vec_id") / 100))
    return selection.select_by_regions(v, "question", S.BUDGET, "core_anchor", "region", "score", "embedding", "vec_id", core="core")


@query(S.CONDITIONAL)
def select_conditional_merge(spark, sf):
    v = vectors(spark, sf).select("question", "vec_id", "embedding", "score")
    top = ranking.top_k(v.withColumnRenamed("vec_id", "candidate_index").withColumn("source_pts", F.col("candidate_index")), ["question"], S.SEEDS)
    seeds = temporal.gap_sessions(top, ["question"], "source_pts", 8)
    spans = seeds.groupBy("question", "core_id").agg(F.min("source_pts").alias("left"), F.max("source_pts").alias("right"), F.count(F.lit(1)).alias("seeds"))
    groups = temporal.conditional_groups(spans.withColumns({"left": F.col("left") - 6, "right": F.col("right") + 6}), ["question"], 2)
    owner = temporal.nearest_interval(v, spans, ["question"], "vec_id", ["vec_id"], "core_id").join(groups, ["question", "core_id"])
    rows = v.join(owner.select("question", "vec_id", (F.col("question") * 1000 + F.col("group_id")).cast("long").alias("region"), "weight"), ["question", "vec_id"])
    return selection.select_by_regions(rows, "question", S.BUDGET, "coverage", "region", "score", "embedding", "vec_id")


@query(S.LAST_SLOT)
def last_slot_swap(spark, sf):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, region = rows["vec_id"].to_numpy(), rows["region"].to_numpy()
        orders = [m[np.argsort(-rows["score"].to_numpy()[m], kind="stable")].tolist() for m in (np.flatnonzero(region == r) for r in sorted(set(region)))]
        taken = selection.last_slot_swap(orders, [3] * len(orders), (ids * 53 % 97) / 97.0)
        return pd.DataFrame({"question": rows["question"].iloc[0], "region": region[taken], "vec_id": ids[taken]})

    return selection.grouped(vectors(spark, sf).select("question", "region", "vec_id", "score"), ["question"], run, "question long, region long, vec_id long", ["vec_id"]).select("question", "region", F.col("vec_id"))


@query(f"""WITH RECURSIVE {SQL_C}, o AS (SELECT question_id, candidate_index, source_pts AS t, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS n FROM c WHERE score > 0),
r AS (SELECT question_id, 1::BIGINT AS n, [t] AS held, 1 AS step, candidate_index FROM o WHERE n = 1
  UNION ALL
  SELECT r.question_id, o.n, CASE WHEN ok THEN list_append(held, t) ELSE held END, CASE WHEN ok THEN len(held) + 1 END, o.candidate_index
  FROM (SELECT r.question_id, r.held, r.n + 1 AS n FROM r WHERE len(held) < 4) r JOIN (SELECT *, true AS x FROM o) o ON o.question_id = r.question_id AND o.n = r.n, LATERAL (SELECT len(list_filter(held, lambda y: abs(y - o.t) <= {24 * HOUR})) = 0 AS ok) k)
SELECT question_id, candidate_index, CAST(step AS INTEGER) AS step FROM r WHERE step IS NOT NULL""")
def outside_suppressed(spark, sf):
    return matching.suppressed(candidates(spark, sf), QUESTION, "source_pts", "score", "candidate_index", 24 * HOUR, 4)


_SEEDS = f"{SQL_R}, sr AS (SELECT k.question_id, i.region_id, k.candidate_index, k.score, k.event_id FROM k JOIN i ON i.question_id = k.question_id AND i.core_id = k.core_id)"


@query(f"""WITH {_SEEDS}, x AS (SELECT sr.*, n, CASE WHEN n = 0 THEN score ELSE CAST((event_id * n) % 11 AS DOUBLE) / 10 END AS s FROM sr, (SELECT unnest([0, 1, 2]) AS n)),
p AS (SELECT *, max(s) OVER (PARTITION BY question_id, region_id, n) AS peak FROM x),
e AS (SELECT question_id, region_id, candidate_index, max(CASE WHEN peak > 0 THEN s / peak ELSE 0 END) AS w FROM p GROUP BY ALL)
SELECT question_id, region_id, candidate_index, round(CASE WHEN max(w) OVER (PARTITION BY question_id, region_id) > 0 THEN w ELSE 1 END, 9) AS weight FROM e""")
def multi_query_support(spark, sf):
    c = candidates(spark, sf)
    owner = temporal.merge_intervals(windows(c), QUESTION).select("question_id", "core_id", "region_id")
    seeds = cores(c).join(owner, ["question_id", "core_id"]).select("question_id", "region_id", "candidate_index", "score", "event_id")
    asked = seeds.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("n")).withColumn("s", F.when(F.col("n") == 0, F.col("score")).otherwise((F.col("event_id") * F.col("n") % 11).cast("double") / 10))
    return sets.query_seed_weights(asked, ["question_id", "region_id"], "n", "candidate_index", "s").withColumn("weight", F.round("weight", 9))


_BANK = f"""t AS (SELECT question_id, r, unnest(range(l + {HOUR}, r + 1, {6 * HOUR})) AS target FROM g),
n AS (SELECT t.question_id, target, t.r, min(source_pts) AS source FROM t LEFT JOIN c ON c.question_id = t.question_id AND source_pts >= target GROUP BY ALL),
mm AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY target) AS nth FROM n),
bank AS (SELECT mm.question_id, target, source, CASE WHEN source IS NULL THEN 'no_source' WHEN source > mm.r THEN 'outside_window' WHEN s.source_pts IS NOT NULL OR nth > 1 THEN 'duplicate_source' ELSE 'added' END AS status FROM mm LEFT JOIN s ON s.question_id = mm.question_id AND s.source_pts = source)"""


def _repooled(names) -> str:
    none, outside, twice, kept = names
    return f"""fit AS (SELECT bank.*, status IN ('added', 'duplicate_source') AS known, coalesce(status IN ('added', 'duplicate_source') AND source BETWEEN wl AND wr, false) AS ok FROM bank JOIN nw ON nw.question_id = bank.question_id AND target BETWEEN wl AND wr),
z AS (SELECT *, row_number() OVER (PARTITION BY question_id, source, ok ORDER BY target) AS k FROM fit)
SELECT z.question_id, z.target, z.source, CASE WHEN NOT known THEN '{none}' WHEN NOT ok THEN '{outside}' WHEN s.source_pts IS NOT NULL OR k > 1 THEN '{twice}' ELSE '{kept}' END AS status FROM z LEFT JOIN s ON s.question_id = z.question_id AND s.source_pts = z.source"""


def _bank(c):
    r = regions(c)
    targets = r.withColumn("target", F.explode(F.sequence(F.col("left") + HOUR, F.greatest("right", F.col("left") + HOUR), F.lit(6 * HOUR)))).where("target <= right").select("question_id", "target", "right")
    return pools.fine_pool(ranking.top_k(c, QUESTION, 16), targets, c, QUESTION, "source_pts")[1]


@query(f"""WITH {SQL_R}, {_BANK},
hw AS (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w WHERE seeds >= 3),
hi AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS h FROM hw),
nw AS (SELECT question_id, min(l) AS wl, max(r) AS wr FROM hi GROUP BY question_id, h), {_repooled(pools.SCOPED)}""")
def scoped_pool(spark, sf):
    c = candidates(spark, sf)
    hot = temporal.merge_intervals(windows(c).where("seeds >= 3"), QUESTION).groupBy("question_id", "region_id").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    return pools.repooled(_bank(c), hot, ranking.top_k(c, QUESTION, 16), QUESTION, "source_pts", 24 * HOUR)


@query(f"""WITH {SQL_R}, {_BANK},
s8 AS (SELECT *, CASE WHEN source_pts - lag(source_pts) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) > {GAP} THEN 1 ELSE 0 END AS o FROM s WHERE rk <= 8),
k8 AS (SELECT *, sum(o) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) AS core_id FROM s8),
w8 AS (SELECT question_id, core_id, count(*) AS seeds, greatest(min(source_pts) - {RADIUS}, low) AS l, least(max(source_pts) + {RADIUS}, high) AS r FROM k8 JOIN b USING (question_id) GROUP BY question_id, core_id, low, high),
i8 AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS h FROM (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w8)),
nw AS (SELECT question_id, min(l) AS wl, max(r) AS wr FROM i8 GROUP BY question_id, h HAVING max(seeds) >= 3), {_repooled(pools.RETARGETED)}""")
def retargeted_pool(spark, sf):
    c = candidates(spark, sf)
    return pools.repooled(_bank(c), regions(c, 8).where("refine"), ranking.top_k(c, QUESTION, 16), QUESTION, "source_pts", 24 * HOUR, pools.RETARGETED)


@query("""WITH d AS (SELECT doc_id::VARCHAR AS item, n_chars::DOUBLE AS seconds FROM documents),
p AS (SELECT item, min(place) AS place FROM (SELECT item, place FROM (SELECT item, row_number() OVER (ORDER BY item) AS place FROM d) WHERE place <= 5 UNION ALL SELECT '133', 6 UNION ALL SELECT '13', 7) GROUP BY item)
SELECT item, seconds, row_number() OVER (ORDER BY place NULLS LAST, seconds DESC, item) AS ordinal FROM d LEFT JOIN p USING (item)""")
def duration_queue(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item"), F.col("n_chars").cast("double").alias("seconds"))
    return ranking.duration_queue(d, "item", "seconds", ranking.pilots(d, "item", ["item"], 5, ["133", "13"]))


_RAW = "CASE doc_id % 9 WHEN 0 THEN 'local' WHEN 1 THEN ' GLOBAL ' WHEN 2 THEN 'Mixed' WHEN 3 THEN lang WHEN 4 THEN source WHEN 5 THEN lower(substr(source, 4, 1)) WHEN 6 THEN substr('ABCDE', CAST(n_chars % 5 + 1 AS INT), 1) || '.' WHEN 7 THEN lang || '.' ELSE coalesce(substr(trim(text), 1, 1), '') END"


@query(f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents)
SELECT doc_id, CASE WHEN upper(trim(raw)) IN ('LOCAL', 'GLOBAL', 'MIXED') THEN upper(trim(raw)) ELSE 'MIXED' END AS scope, upper(trim(raw)) NOT IN ('LOCAL', 'GLOBAL', 'MIXED') AS fallback,
CASE WHEN regexp_full_match(trim(raw), '[A-Da-d]\\.?') THEN upper(trim(raw)[1]) ELSE 'D' END AS category, regexp_full_match(trim(raw), '[A-Da-d]\\.?') AS valid FROM r""")
def scopes(spark, sf):
    """Scopes and categories as said in words, letters and first letters of documents."""
    raw = F.expr(_RAW)
    return table(spark, sf, "documents").select("doc_id", parsing.parse_scope(raw).alias("s"), parsing.parse_category(raw).alias("c")).select("doc_id", "s.*", "c.*")


@query("""SELECT doc_id, n_chars % 32 + 1 + (n_chars % 32 + 1) % 2 AS frames, (n_chars - doc_id) / 2.0::DOUBLE AS content, (n_chars + doc_id) / 2.0::DOUBLE AS position, b.n AS box, b.x AS x1, b.y AS y1, b.x + w AS x2, b.y + h AS y2
FROM (SELECT *, (100 + n_chars % 900) // 2 AS w, (50 + doc_id % 700) // 2 AS h, 100 + n_chars % 900 AS fw, 50 + doc_id % 700 AS fh FROM documents),
LATERAL (SELECT unnest([{'n': 0, 'x': 0, 'y': 0}, {'n': 1, 'x': fw - w, 'y': 0}, {'n': 2, 'x': 0, 'y': fh - h}, {'n': 3, 'x': fw - w, 'y': fh - h}, {'n': 4, 'x': (fw - w) // 2, 'y': (fh - h) // 2}]) AS b) u""")
def frame_arithmetic(spark, sf):
    d = table(spark, sf, "documents").withColumn("n_chars", F.col("n_chars").cast("long"))
    p = parsing.by_position(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"))
    boxes = F.posexplode(parsing.quarter_boxes(100 + F.col("n_chars") % 900, 50 + F.col("doc_id") % 700)).alias("box", "b")
    return d.select("doc_id", parsing.padded(F.col("n_chars") % 32 + 1).alias("frames"), p["content"].alias("content"), p["position"].alias("position"), boxes).select("doc_id", "frames", "content", "position", "box", "b.*")


@query(f"""WITH {SQL_V}, o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, vec_id) AS rk, list_slice(e, 1, 32) AS z FROM v),
p AS (SELECT a.region, a.vec_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS old, list_dot_product(a.z, b.z) / sqrt(list_dot_product(a.z, a.z) * list_dot_product(b.z, b.z)) AS new, a.vec_id % 5 <> 0 AND b.vec_id % 5 <> 0 AS ok
      FROM o a JOIN o b ON a.region = b.region AND b.rk <= 4 AND a.rk > 4)
SELECT region, vec_id, round(max(greatest(0.0, least(1.0, CASE WHEN ok THEN new ELSE old END))), 6) AS redundancy FROM p GROUP BY region, vec_id""")
def conditional_redundancy(spark, sf):
    v = vectors(spark, sf).select("region", "vec_id", "score", "embedding", F.slice("embedding", 1, 32).alias("state"), (F.col("vec_id") % 5 != 0).alias("valid"))
    rk = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "vec_id"))
    ranked = v.withColumn("rk", rk)
    held = ranked.where("rk <= 4").select("region", *(F.col(c).alias(f"_{c}") for c in ("embedding", "state", "valid")))
    pairs = ranked.where("rk > 4").join(held, "region")
    out = redundancy(cosine(F.col("embedding"), F.col("_embedding")), cosine(F.col("state"), F.col("_state")), F.col("valid") & F.col("_valid"))
    return pairs.groupBy("region", "vec_id").agg(F.round(out, 6).alias("redundancy"))


_GAMMA, _BETA = [1 + i % 7 / 10 for i in range(64)], [i % 5 / 10 - 0.1 for i in range(64)]
_W, _B = [[(i * (r + 3) % 11 - 5) / 10 for i in range(64)] for r in range(4)], [r / 10 for r in range(4)]
_LIMIT = max(_GAMMA) * 8 + sum(b * b for b in _BETA) ** 0.5


@query(f"""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS f FROM u WHERE list_dot_product(e, e) > 0),
s AS (SELECT vec_id, f, {sum(b / g for b, g in zip(_BETA, _GAMMA, strict=True))!r}::DOUBLE / list_dot_product(f, {[1 / g for g in _GAMMA]!r}::DOUBLE[]) AS scale FROM f),
y AS (SELECT vec_id, scale, [{', '.join(f'scale * list_dot_product(f, {w!r}::DOUBLE[]) + {b!r}::DOUBLE' for w, b in zip(_W, _B, strict=True))}] AS y FROM s WHERE scale > 0 AND scale <= {_LIMIT!r}::DOUBLE * 1.00001)
SELECT vec_id, round(scale, 6) AS scale, p - 1 AS place, round(y[p] / sqrt(list_dot_product(y, y)), 6) AS value FROM (SELECT *, unnest([1, 2, 3, 4]) AS p FROM y)""")
def projection_recovery(spark, sf):
    unit = F.expr("transform(embedding, x -> CAST(x AS DOUBLE) / sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (s, y) -> s + CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))")
    v = table(spark, sf, "embeddings").select("vec_id", unit.alias("f")).select("vec_id", recovered_projection(F.col("f"), _GAMMA, _BETA, _W, _B).alias("p")).where("p IS NOT NULL")
    return v.select("vec_id", F.round("p.scale", 6).alias("scale"), F.posexplode("p.vector").alias("place", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {SQL_R}, t AS (SELECT question_id, region_id, unnest(range(l + {HOUR}, r + 1, {6 * HOUR})) AS target FROM g WHERE refine),
hi AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS h FROM (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w WHERE seeds >= 3)),
hot AS (SELECT question_id, min(l) AS hl, max(r) AS hr FROM hi GROUP BY question_id, h),
n AS (SELECT question_id, region_id, count(*) AS targets, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM hot WHERE hot.question_id = t.question_id AND target BETWEEN hl AND hr)) AS cold_targets FROM t GROUP BY question_id, region_id),
x AS (SELECT k.question_id, i.region_id, arg_min(candidate_index, rk) AS anchor, min(rk) AS anchor_rank, arg_min(20 * (source_pts - low) >= 19 * (high - low), rk) AS late_anchor FROM k JOIN i USING (question_id, core_id) JOIN b USING (question_id) GROUP BY k.question_id, i.region_id),
f AS (SELECT question_id, region_id, min(seeds) AS few FROM i GROUP BY question_id, region_id)
SELECT question_id, region_id, m, c, m - c AS edges, refine, (m - c + 1 >= 3) <> refine AS weight_differs, refine AND few < 3 AS mixed, anchor, anchor_rank, late_anchor, coalesce(targets, 0) AS targets, coalesce(cold_targets, 0) AS cold_targets
FROM g JOIN x USING (question_id, region_id) JOIN f USING (question_id, region_id) LEFT JOIN n USING (question_id, region_id)""")
def region_summary(spark, sf):
    c = candidates(spark, sf)
    merged = temporal.merge_intervals(windows(c), QUESTION).select("question_id", "core_id", "region_id", "seeds", "left", "right")
    targets = regions(c).where("refine").select("question_id", "region_id", "right", F.explode(F.sequence(F.col("left") + HOUR, F.greatest("right", F.col("left") + HOUR), F.lit(6 * HOUR))).alias("target")).where("target <= right").drop("right")
    seeds = cores(c).join(bounds(c), QUESTION).select("question_id", "core_id", "candidate_index", "source_pts", "score", "low", "high")
    return reports.region_summary(merged, seeds, targets, QUESTION, "source_pts", "score", "candidate_index", "low", "high", 24 * HOUR)


@query(f"""WITH {SQL_V}, o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rk FROM v), h AS (SELECT * FROM o WHERE rk <= 32),
x AS (SELECT a.question, a.vec_id, a.region, a.score, coalesce(max(CASE WHEN b.vec_id IS NOT NULL THEN greatest(0.0, least(1.0, list_dot_product(a.e, b.e) / (a.n * b.n))) END), 0) AS near FROM h a LEFT JOIN h b ON a.region = b.region AND a.question = b.question AND a.vec_id <> b.vec_id GROUP BY ALL),
t AS (SELECT question, count(DISTINCT region) AS segments FROM v GROUP BY question)
SELECT question, segments, count(DISTINCT region) AS covered, round(avg(score), 6) AS relevance, round(avg(near), 6) AS redundancy, round(1 - count(DISTINCT region) / segments, 6) AS unused FROM x JOIN t USING (question) GROUP BY question, segments""")
def selection_statistics(spark, sf):
    v = vectors(spark, sf)
    rk = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "vec_id"))
    taken = v.withColumn("rk", rk).where("rk <= 32").select("question", "region", "vec_id", "score", "embedding")
    out = reports.selection_statistics(taken, v.select("question", "region"), ["question"], "region", "vec_id", "score", clipped(cosine(F.col("a.embedding"), F.col("b.embedding"))))
    return out.select("question", "segments", "covered", *(F.round(c, 6).alias(c) for c in ("relevance", "redundancy", "unused")))


_WINDOWS_8 = f"""s8 AS (SELECT *, CASE WHEN source_pts - lag(source_pts) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) > {GAP} THEN 1 ELSE 0 END AS o FROM s WHERE rk <= 8),
k8 AS (SELECT *, sum(o) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) AS core_id FROM s8),
w8 AS (SELECT question_id, core_id, count(*) AS seeds, greatest(min(source_pts) - {RADIUS}, low) AS l, least(max(source_pts) + {RADIUS}, high) AS r FROM k8 JOIN b USING (question_id) GROUP BY question_id, core_id, low, high),
i8 AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS h FROM (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w8)),
g8 AS (SELECT question_id, min(l) AS l, max(r) AS r FROM i8 GROUP BY question_id, h)"""


@query(f"""WITH {SQL_R}, {_WINDOWS_8}, z AS (SELECT coalesce(g.question_id, g8.question_id) AS question_id, g.l IS NOT NULL AS x, g8.l IS NOT NULL AS y FROM g FULL JOIN g8 ON g.question_id = g8.question_id AND g.l = g8.l AND g.r = g8.r)
SELECT question_id, count(*) FILTER (WHERE x) AS frozen, count(*) FILTER (WHERE y) AS recomputed, count(*) FILTER (WHERE x AND y) AS same FROM z GROUP BY question_id""")
def geometry_check(spark, sf):
    c = candidates(spark, sf)
    one = lambda df, side: df.select("question_id", "left", "right", F.lit(side).alias("side"))
    both = one(regions(c), 1).unionByName(one(regions(c, 8), 2)).groupBy("question_id", "left", "right").agg(F.sum("side").alias("sides"))
    n = lambda *sides: F.count_if(F.col("sides").isin(*sides))
    return both.groupBy("question_id").agg(n(1, 3).alias("frozen"), n(2, 3).alias("recomputed"), n(3).alias("same"))
