"""Queries of repaired selections and of regions that show a field, and of divergences between answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking, repair
from ..sources.shared import saved
from .registry import query
from .views import HOUR, QUESTION, SQL_C, candidates, table

ITEM = ["question_id", "candidate_index"]
_CONF = "((event_id * 7) % 97) / 97.0::DOUBLE"
_POOL = f"""{SQL_C}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c),
p AS (SELECT question_id, candidate_index AS i, source_pts AS t, event_id % 5 <> 0 AS coarse, score, CASE WHEN event_id % 11 <> 0 THEN candidate_index + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS target, rk <= 16 AS selected, rk <= 3 AS protected, {_CONF} AS v FROM r),
w AS (SELECT *, lag(selected) OVER x AS before, lead(i) OVER x AS ni, lead(t) OVER x AS nt, lead(target) OVER x AS ntarget, lead(selected) OVER x AS nsel, lead(v) OVER x AS nv FROM p WINDOW x AS (PARTITION BY question_id ORDER BY t, i)),
s AS (SELECT *, lead(i) OVER x AS bi, lead(t) OVER x AS bt, lead(protected) OVER x AS bp, lead(v) OVER x AS bv, row_number() OVER x - 1 AS slot FROM w WHERE selected WINDOW x AS (PARTITION BY question_id ORDER BY t, i)),
g AS (SELECT *, (1 - abs(v - nv)) - (1 - abs(v - bv)) AS gain FROM s),
d AS (SELECT *, CASE WHEN NOT coarse THEN 'no_score' WHEN bi IS NULL THEN 'no_next_slot' WHEN coalesce(before, false) OR coalesce(nsel, false) THEN 'neighbour_selected' WHEN bp THEN 'next_protected' WHEN ni IS NULL THEN 'no_successor'
  WHEN target IS NULL OR ntarget IS NULL THEN 'no_target' WHEN ntarget - target <> 1 THEN 'not_next_target' WHEN NOT (t < nt AND nt < bt) THEN 'outside_slot' WHEN gain <= 1e-8 THEN 'no_gain' ELSE 'eligible' END AS reason FROM g)"""


def _decisions(spark, sf):
    c = candidates(spark, sf)
    top = lambda n, name: ranking.top_k(c, QUESTION, n).select(*ITEM, F.lit(True).alias(name))
    p = c.join(top(16, "selected"), ITEM, "left").join(top(3, "protected"), ITEM, "left").fillna(False, ["selected", "protected"])
    target = F.when(F.col("event_id") % 11 != 0, F.col("candidate_index") + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
    pool = saved(p.select(*ITEM, "source_pts", (F.col("event_id") % 5 != 0).alias("coarse"), "score", target.alias("target"), "selected", "protected", (F.pmod(F.col("event_id") * 7, F.lit(97)) / 97.0).alias("v")), "pool")
    return pool, repair.repair_decisions(pool, QUESTION, "candidate_index", "source_pts", lambda a, b: 1 - F.abs(a["v"] - b["v"]), 1)


@query(f"WITH {_POOL} SELECT question_id, slot, i AS candidate_index, reason, round(CASE WHEN reason IN ('no_gain', 'eligible') THEN gain END, 9) + 0.0 AS gain FROM d")
def repair_decisions(spark, sf):
    """Why each of sixteen selected events may or may not give the next slot to its successor."""
    _, d = _decisions(spark, sf)
    return d.select("question_id", F.col("slot").cast("long").alias("slot"), "candidate_index", "reason", (F.round(F.when(F.col("reason").isin("no_gain", "eligible"), F.col("gain")), 9) + 0.0).alias("gain"))


@query(f"""WITH {_POOL}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, gain DESC, t, nt, i, ni) AS n FROM d WHERE reason = 'eligible') WHERE n = 1)
SELECT question_id, i AS candidate_index, t AS source_pts, 'kept' AS origin FROM p WHERE selected AND NOT EXISTS (SELECT 1 FROM b WHERE b.question_id = p.question_id AND b.bi = p.i) UNION ALL SELECT question_id, ni, nt, 'added' FROM b""")
def repaired_selection(spark, sf):
    """The selections after their best repair."""
    pool, d = _decisions(spark, sf)
    return repair.repaired(pool, QUESTION, "candidate_index", "source_pts", d)


_R = 24 * HOUR
_REGIONS = f"""{SQL_C}, b AS (SELECT question_id, min(source_pts) AS low, max(source_pts) AS high FROM c GROUP BY question_id),
f AS (SELECT c.*, event_type AS field, {_CONF} AS confidence FROM c), u AS (SELECT *, candidate_index - row_number() OVER (PARTITION BY question_id, field ORDER BY candidate_index) AS run FROM f),
g AS (SELECT question_id, field, run, min(candidate_index) AS first, max(candidate_index) AS last, arg_min(candidate_index, (-confidence, source_pts)) AS representative, max(confidence) AS confidence, greatest(min(source_pts) - {_R}, any_value(low)) AS l, least(max(source_pts) + {_R}, any_value(high)) AS r FROM u JOIN b USING (question_id) GROUP BY question_id, field, run),
x AS (SELECT g.question_id, g.field, g.first, g.last, g.representative, g.confidence, count(*) AS context, arg_min(c.candidate_index, (-c.score, c.source_pts)) AS anchor, max(c.score) AS context_score FROM g JOIN c ON c.question_id = g.question_id AND c.source_pts BETWEEN g.l AND g.r GROUP BY ALL)"""


def _regions(spark, sf):
    w = Window.partitionBy("question_id")
    c = candidates(spark, sf).withColumns({"low": F.min("source_pts").over(w), "high": F.max("source_pts").over(w)})
    fields = c.select(*ITEM, F.col("event_type").alias("field"), (F.pmod(F.col("event_id") * 7, F.lit(97)) / 97.0).alias("confidence"))
    return c, repair.field_regions(fields, c, QUESTION, "candidate_index", "source_pts", "score", _R, "low", "high")


@query(f"WITH {_REGIONS} SELECT question_id, field, first, last, representative, round(confidence, 9) AS confidence, context, anchor, round(context_score, 9) AS context_score FROM x")
def field_regions(spark, sf):
    """Runs of events of one type, with their surest event, and the best event within a day of them."""
    _, r = _regions(spark, sf)
    return r.select("question_id", "field", "first", "last", "representative", F.round("confidence", 9).alias("confidence"), "context", "anchor", F.round("context_score", 9).alias("context_score"))


@query(f"WITH {_REGIONS}, y AS (SELECT question_id, representative AS candidate_index, array_to_string(list_sort(list(field)), ',') AS fields, max(context_score) AS s, max(confidence) AS k FROM x GROUP BY question_id, representative) SELECT question_id, candidate_index, fields, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, k DESC, source_pts, candidate_index) AS INTEGER) AS rank FROM y JOIN c USING (question_id, candidate_index)")
def field_proposals(spark, sf):
    """The events that stand for such runs, ranked by what is around them."""
    c, r = _regions(spark, sf)
    out = repair.field_proposals(r, c, QUESTION, "candidate_index", "source_pts")
    return out.select("question_id", "candidate_index", F.array_join("fields", ",").alias("fields"), "rank")


_SOFT = "list_transform({x}, lambda y: exp(y - list_max({x})) / list_sum(list_transform({x}, lambda z: exp(z - list_max({x})))))"
_LOGS = "list_transform({x}, lambda y: y - list_max({x}) - ln(list_sum(list_transform({x}, lambda z: exp(z - list_max({x}))))))"
_HALF = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN 0.5 * z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END))"


@query(f"""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:5], lambda x: 9 * x) AS a, list_transform(CAST(embedding AS DOUBLE[])[6:10], lambda x: 9 * x) AS b FROM embeddings),
p AS (SELECT vec_id, {_SOFT.format(x="a")} AS p, {_SOFT.format(x="b")} AS q, {_LOGS.format(x="a[1:4]")} AS la, {_LOGS.format(x="b[1:4]")} AS lb FROM e),
j AS (SELECT *, least(greatest(({_HALF.format(a="p", b="q")} + {_HALF.format(a="q", b="p")}) / ln(2), 0), 1) AS js FROM p)
SELECT vec_id, round(js, 9) AS js, round(list_sum(p[1:4]), 9) AS mass, round(list_sum(p[1:4]) * js, 9) AS support, round(list_sum(list_transform(list_zip(la, lb), lambda z: exp(z[1]) * (z[1] - z[2]))), 9) AS kl FROM j""")
def answer_divergences(spark, sf):
    """How two distributions of five answers differ: divergence, the mass of the first four, their product, and the divergence of their logits."""
    part = lambda i: F.transform(F.slice("embedding", i, 5), lambda x: 9 * x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", part(1).alias("a"), part(6).alias("b"))
    p = e.select("vec_id", "a", "b", tx.softmax(F.col("a")).alias("p"), tx.softmax(F.col("b")).alias("q"))
    s = p.select("vec_id", tx.evidence_support(F.col("p"), F.col("q")).alias("s"), tx.logit_divergence(F.slice("a", 1, 4), F.slice("b", 1, 4)).alias("kl"))
    return s.select("vec_id", *(F.round(c, 9).alias(n) for c, n in (("s.js", "js"), ("s.mass", "mass"), ("s.value", "support"), ("kl", "kl"))))
