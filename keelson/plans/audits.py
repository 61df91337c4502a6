"""Queries of replays, checked selections and tracked inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes, ranking, replay
from ..sources import tracked
from ..sources.shared import saved
from .geometry import items_of, similar_by
from .registry import query
from .selector_sql import greedy
from .views import QUESTION, SQL_C, candidates, table

_TRACE = greedy("list_position(score, list_max(score))", "score[k] * sqrt(1 - near[k])", "greatest({old}, c[i][k], 0.0)", "least(5, m)")


def _competition(sql: str) -> str:
    """CTEs of the greedy trace and of all that competed (x), then sql."""
    head = _TRACE[: _TRACE.index("\nSELECT region, CAST(step")]
    trace = _TRACE[_TRACE.index("\nSELECT region, CAST(step") + 1 :].replace("CAST(step AS INTEGER) AS step, ids[i] AS vec_id", "step - 1 AS step, i, ids[i] AS item")
    return f"""{head}, tr AS ({trace}),
xs AS (SELECT q.region, w.step, w.item AS winner, q.ids[k] AS item, q.score[k] AS support, list_max(list_transform((SELECT list(i) FROM tr z WHERE z.region = q.region AND z.step < w.step), lambda j: q.c[j][k])) AS redundancy
       FROM (SELECT *, unnest(range(1, m + 1)) AS k FROM q) q JOIN tr w ON w.region = q.region WHERE w.step > 0),
x AS (SELECT xs.*, support * sqrt(greatest(0.0, 1 - redundancy)) AS score, xs.item = winner AS chosen FROM xs LEFT JOIN tr t ON t.region = xs.region AND t.item = xs.item WHERE t.step IS NULL OR t.step >= xs.step)
{sql}"""


def _trace(items):
    """Five items a region by support and likeness alone."""
    none = items.sparkSession.createDataFrame([], "frame long, region long, text string, x1 double, y1 double, x2 double, y2 double")
    return saved(boxes.spatial_prefix(items, similar_by(items), none, lambda df, n: saved(df, f"step{n}"), 5), "trace")


@query(_competition("SELECT region, CAST(step AS INTEGER) AS step, item, round(support, 6) AS support, round(redundancy, 6) AS redundancy, round(score, 6) AS score, chosen FROM x"))
def competition_replay(spark, sf):
    """All that competed for each slot of a region's prefix, from the trace of winners."""
    items = saved(items_of(spark, sf), "items")
    out = replay.competition(_trace(items), items, similar_by(items))
    return out.select("region", "step", "item", *(F.round(c, 6).alias(c) for c in ("support", "redundancy", "score")), "chosen")


@query(_competition("""
SELECT e.region, e.item, name, quota, e."end", CAST(e.step AS INTEGER) AS step, round(o.score, 6) AS target_score, round(w.score, 6) AS winner_score, round(w.score - o.score, 6) AS margin FROM (
  SELECT *, CASE "end" WHEN 'selected' THEN place WHEN 'lost_at_last_slot' THEN quota - 1 END AS step FROM (
    SELECT y.region, y.item, name, quota, t.step AS place, CASE WHEN t.step = 0 THEN 'protected_anchor' WHEN t.step < quota THEN 'selected' WHEN quota = 1 THEN 'no_open_slot' ELSE 'lost_at_last_slot' END AS "end"
    FROM (SELECT region, unnest(ids) AS item FROM q) y LEFT JOIN tr t ON t.region = y.region AND t.item = y.item, (SELECT unnest(['few', 'one', 'many']) AS name, unnest([3, 1, 5]) AS quota) WHERE y.item % 3 = 0)) e
LEFT JOIN x o ON o.region = e.region AND o.step = e.step AND o.item = e.item LEFT JOIN (SELECT * FROM x WHERE chosen) w ON w.region = e.region AND w.step = e.step"""))
def competition_margins(spark, sf):
    """By how much every third item missed, or won, its place under quotas of one, three and five."""
    items = saved(items_of(spark, sf), "items")
    quotas = items.select("region").distinct().select("region", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("quota")) for n, k in (("few", 3), ("one", 1), ("many", 5))))).alias("q")).select("region", "q.*")
    out = replay.margins(_trace(items), items, items.where("item % 3 = 0"), quotas, similar_by(items))
    return out.select("region", "item", "name", "quota", "end", "step", *(F.round(c, 6).alias(c) for c in ("target_score", "winner_score", "margin")))


@query(f"WITH {SQL_C}, p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c WHERE event_id % 3 <> 0) SELECT question_id, candidate_index, event_id FROM p WHERE rk <= 8")
def checked_top(spark, sf):
    """The eight best events of each user of which none is unfit (an id divisible by three), looked at only once chosen."""
    c = saved(candidates(spark, sf), "candidates")
    unfit = lambda rows: rows.join(c.select("question_id", "candidate_index", "event_id"), ["question_id", "candidate_index"]).where("event_id % 3 = 0")
    done, _ = replay.checked_selection(c, QUESTION, "candidate_index", lambda pool: ranking.top_k(pool, QUESTION, 8), unfit, saved)
    return done.select("question_id", "candidate_index", "event_id")


_ROW = "concat({})".format(", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "lang", "n_chars", "source", "text")))


@query(f"""WITH d AS (SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS partition, sha256({_ROW}) AS d FROM documents),
s AS (SELECT partition, count(*) AS rows, {", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(8))} FROM d GROUP BY partition)
SELECT 'documents' AS "table", partition, rows, sha256({" || '-' || ".join(f"s{i}" for i in range(8))}) AS digest FROM s""")
def input_manifest(spark, sf):
    """Rows and digests of the documents of each language and source."""
    return tracked.digests(table(spark, sf, "documents"), "documents", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))))
