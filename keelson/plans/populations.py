"""Queries of frozen manifests, exact lookups, profiles of groups, paths of retrieved rows and parsed output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import questions
from ..operators import contracts, pools, ranking, reports, sets, temporal
from .registry import query
from .views import GAP, HOUR, QUESTION, RADIUS, SQL_C, SQL_R, SQL_T, bounds, candidates, cores, regions, results, table, windows

ITEM = ["question_id", "candidate_index"]


@query("""WITH d AS (SELECT doc_id - CASE WHEN doc_id % 97 = 1 THEN 1 ELSE 0 END AS doc_id, lang, source, doc_id % 7 AS kind FROM documents), w AS (SELECT unnest(['en', 'de', 'xx']) AS lang, unnest([500, 200, 5]) AS n),
s AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), g AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS k FROM d GROUP BY source)
SELECT 'repeated' AS kind, CAST(doc_id AS VARCHAR) AS name, 1::BIGINT AS expected, count(*) AS found FROM d GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'stratum', lang, coalesce(w.n, 0), coalesce(s.n, 0) FROM s FULL JOIN w USING (lang) WHERE coalesce(w.n, 0) <> coalesce(s.n, 0)
UNION ALL SELECT 'group_size', source, 50, n FROM g WHERE n <> 50 UNION ALL SELECT 'group_strata', source, 1, k FROM g WHERE k > 1
UNION ALL SELECT 'value', 'kind=' || kind, 0, count(*) FROM d WHERE kind NOT IN (0, 1, 2, 3, 4) GROUP BY kind""")
def manifest_faults(spark, sf):
    """Documents against a manifest that they don't meet: repeated ids, languages and sources of other sizes, and kinds that may not be."""
    d = table(spark, sf, "documents").select((F.col("doc_id") - F.when(F.col("doc_id") % 97 == 1, 1).otherwise(0)).alias("doc_id"), "lang", "source", (F.col("doc_id") % 7).alias("kind"))
    return contracts.population_faults(d, "doc_id", {"en": 500, "de": 200, "xx": 5}, "lang", "source", 50, {"kind": [0, 1, 2, 3, 4]})


@query(f"WITH {SQL_C}, k AS (SELECT DISTINCT question_id, source_pts FROM c WHERE event_type = 'signup'), a AS (SELECT DISTINCT question_id, source_pts FROM c WHERE event_type <> 'view'), m AS (SELECT a.question_id, a.source_pts, k.source_pts AS key_time FROM a ASOF LEFT JOIN k ON a.question_id = k.question_id AND a.source_pts >= k.source_pts) SELECT question_id, key_time, count(*) AS n, min(source_pts) AS first, max(source_pts) AS last FROM m GROUP BY question_id, key_time")
def key_frame_groups(spark, sf):
    """Requested times of each user that one seek to the last signup before them serves."""
    c = candidates(spark, sf)
    return temporal.by_key_frame(c.where("event_type <> 'view'").select("question_id", "source_pts"), c.where("event_type = 'signup'").select("question_id", "source_pts"), QUESTION, "source_pts").select("question_id", "key_time", "n", "first", "last")


@query(f"WITH {SQL_R} SELECT c.question_id, c.candidate_index, g.region_id FROM c JOIN g ON c.question_id = g.question_id AND c.source_pts BETWEEN g.l AND g.r")
def window_members(spark, sf):
    """Events within the windows of their user's regions, each of which must hold as many as it has seeds."""
    c = candidates(spark, sf)
    r = regions(c)
    return temporal.inside_windows(c, r, QUESTION, "source_pts", 24 * HOUR, "region_id", r.select("question_id", "region_id", F.col("m").alias("quota"))).select(*ITEM, "region_id")


@query("WITH b AS (SELECT DISTINCT event_type, props FROM events WHERE event_id % 5 <> 0), w AS (SELECT e.user_id, e.event_id, sha256(e.event_type || e.props) AS h, b.props IS NOT NULL AS has FROM events e LEFT JOIN b ON e.event_type = b.event_type AND e.props = b.props WHERE user_id % 2 = 0 AND event_id % 20 = 0) SELECT user_id, event_id, CASE WHEN bool_and(has) OVER (PARTITION BY user_id) THEN h END AS h, bool_and(has) OVER (PARTITION BY user_id) AS complete FROM w")
def reused_digests(spark, sf):
    """Digests of events by their type and properties, taken from a bank of four in five events where all of a user's are there, else none."""
    e = table(spark, sf, "events").withColumn("h", F.sha2(F.concat("event_type", "props"), 256))
    bank = sets.lookup_bank(e.where("event_id % 5 <> 0"), ["event_type", "props"], "h")
    want = e.where("user_id % 2 = 0 AND event_id % 20 = 0").select("user_id", "event_id", "event_type", "props")
    return sets.looked_up(want, bank, ["user_id"], ["event_type", "props"], "h").select("user_id", "event_id", "h", "complete")


@query(f"""WITH {SQL_T}, r AS (SELECT stratum, cluster, a, b, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' WHEN b THEN 'right' ELSE 'none' END AS cell, doc_id % 13 AS p FROM t)
SELECT coalesce(stratum, 'all') AS stratum, coalesce(cluster, 'all') AS cluster, coalesce(cell, 'all') AS cell, count(*) AS n, count(CASE WHEN a THEN 1 END) AS right_a, round(count(CASE WHEN b THEN 1 END) / count(*)::DOUBLE, 6) AS rate_b,
       count(CASE WHEN r.cell = 'left' THEN 1 END) AS cell_left, round(avg(p), 6) AS mean_p, quantile_cont(p, 0.5) AS median_p FROM r GROUP BY GROUPING SETS ((stratum), (cluster), (cell), (stratum, cluster), ())""")
def group_profiles(spark, sf):
    """Counts, shares, cells, means and medians by language, source, cell, and language and source."""
    t = results(spark, sf)
    cell = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "left").when(F.col("b"), "right").otherwise("none")
    out = reports.group_profile(t.withColumns({"cell": cell, "p": F.col("doc_id") % 13}), [["stratum"], ["cluster"], ["cell"], ["stratum", "cluster"], []], ["a", "b"], "cell", ["both", "left"], ["p"])
    return out.select("stratum", "cluster", "cell", "n", "right_a", F.round("rate_b", 6).alias("rate_b"), "cell_left", F.round("mean_p", 6).alias("mean_p"), "median_p")


@query(f"""WITH {SQL_C}, m AS (SELECT *, row_number() OVER (PARTITION BY question_id, event_type ORDER BY event_id % 101, source_pts) AS place, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c),
u AS (SELECT question_id, event_type, unnest(['even', 'long']) AS method, unnest([2 + question_id % 2, length(event_type) - 2]) AS quota FROM (SELECT DISTINCT question_id, event_type FROM c)),
r AS (SELECT *, sum(quota) OVER w - count(*) OVER w + 1 AS room FROM u WINDOW w AS (PARTITION BY question_id, method)), z AS (SELECT question_id, event_type, max(place) AS size FROM m WHERE place <= 9 GROUP BY question_id, event_type),
x AS (SELECT m.question_id, m.candidate_index, m.event_type, CASE WHEN m.place <= 9 THEN m.place END AS place, least(size, room) AS capacity, method, quota FROM m JOIN r USING (question_id, event_type) JOIN z USING (question_id, event_type) WHERE rk <= 12)
SELECT question_id, candidate_index, event_type, place, CAST(capacity AS BIGINT) AS capacity, method, quota, CASE WHEN place IS NULL THEN 'outside_prefix' WHEN place <= quota THEN 'selected' WHEN place <= capacity THEN 'quota_reachable' ELSE 'beyond_capacity' END AS state, CASE WHEN place IS NOT NULL THEN greatest(place - quota, 0) END AS more FROM x""")
def retrieved_paths(spark, sf):
    """Whether the twelve best events of each user are taken from prefixes by type under two sets of quotas, or could be."""
    c = candidates(spark, sf)
    place = F.row_number().over(Window.partitionBy("question_id", "event_type").orderBy(F.col("event_id") % 101, "source_pts")).cast("long")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "source_pts", "candidate_index"))
    m = c.withColumns({"place": place, "rk": rank})
    quotas = c.select("question_id", "event_type").distinct().select("question_id", "event_type", F.explode(F.array(F.struct(F.lit("even").alias("method"), (2 + F.col("question_id") % 2).cast("long").alias("quota")), F.struct(F.lit("long").alias("method"), (F.char_length("event_type") - 2).cast("long").alias("quota")))).alias("x")).select("question_id", "event_type", "x.*")
    keep = ["question_id", "event_type", "candidate_index"]
    return reports.path_states(m.where("rk <= 12").select(*ITEM), m.where("place <= 9").select(*keep, "place"), quotas, m.select(*keep), QUESTION, "event_type", "candidate_index")


@query("""WITH e AS (SELECT event_id, event_id % 6 AS form, event_type AS t, user_id AS u FROM events)
SELECT event_id, CASE form WHEN 2 THEN 'shape' WHEN 3 THEN 'not_json' WHEN 4 THEN 'list' END AS reason, CASE WHEN form IN (0, 1, 5) THEN t || '|user ' || u ELSE '' END AS texts, form IN (0, 5) AS strict, CASE form WHEN 0 THEN t || ' of user' WHEN 5 THEN '' ELSE 'bad' END AS known FROM e""")
def parsed_output(spark, sf):
    """Facts and phrases of objects in texts of JSON, by strict shapes: fenced, of another shape, cut off, blank, or with words that the question doesn't license."""
    e, form, t, u = table(spark, sf, "events"), F.col("event_id") % 6, F.col("event_type"), F.col("user_id").cast("string")
    good = F.concat(F.lit('{"observations": ["'), t, F.lit('", "user '), u, F.lit('"], "visible_text": []}'))
    raw = F.when(form.isin(0, 5), good).when(form == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(form == 2, F.replace(good, F.lit("[]"), F.lit("[1]"))).when(form == 3, F.substr(good, F.lit(1), F.lit(20))).otherwise(F.replace(good, F.lit("[]"), F.lit('[" "]')))
    ask = F.concat(F.lit("Which "), t, F.lit("s of which users?"))
    objects = F.concat(F.lit('{"known": ['), F.when(form == 0, F.concat(F.lit('"'), F.initcap(t), F.lit(' of User"'))).when(form == 5, "").otherwise('"unicorn"'), F.lit('], "choices": [[], [], [], []]}'))
    o = questions.object_queries(objects, ask, F.array(*(F.lit(x) for x in ("a", "b", "c", "d"))))
    found = e.select("event_id", questions.facts(raw, F.lit(False)).alias("f"), o.alias("o"))
    return found.select("event_id", "f.reason", F.array_join("f.observations", "|").alias("texts"), "f.strict", F.when(F.col("o.reason").isNull(), F.array_join("o.known", "|")).otherwise("bad").alias("known"))


@query(f"""WITH {SQL_R}, h AS (SELECT question_id, l, r FROM i WHERE seeds >= 3), f AS (SELECT question_id, source_pts, event_id % 8 = 1 AS selected FROM c WHERE event_id % 4 = 1),
m AS (SELECT f.*, g.region_id, NOT EXISTS (SELECT 1 FROM h WHERE h.question_id = f.question_id AND f.source_pts BETWEEN h.l AND h.r) AS cold FROM f JOIN g ON f.question_id = g.question_id AND f.source_pts BETWEEN g.l AND g.r)
SELECT g.question_id, g.region_id, count(m.source_pts) AS fine, count(CASE WHEN cold THEN 1 END) AS fine_outside, count(CASE WHEN selected THEN 1 END) AS selected_fine, count(CASE WHEN selected AND cold THEN 1 END) AS selected_outside
FROM g LEFT JOIN m ON g.question_id = m.question_id AND g.region_id = m.region_id GROUP BY ALL""")
def fine_rows(spark, sf):
    """Every fourth event as a fine row: how many lie in each region, and how many of them outside the windows of cores with three seeds."""
    c = candidates(spark, sf)
    cores = temporal.merge_intervals(windows(c), QUESTION)
    return reports.fine_summary(cores, c.where("event_id % 4 = 1").select("question_id", "source_pts", (F.col("event_id") % 8 == 1).alias("selected")), QUESTION, "source_pts", 24 * HOUR)


@query(f"""WITH {SQL_R}, x AS (SELECT k.question_id, greatest(source_pts - {RADIUS}, low) AS l, least(source_pts + {RADIUS}, high) AS r FROM k JOIN b USING (question_id)),
y AS (SELECT *, sum(CASE WHEN l > p THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY l, r) AS n FROM (SELECT *, max(r) OVER (PARTITION BY question_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)),
u AS (SELECT question_id, min(l) AS l, max(r) AS r FROM y GROUP BY question_id, n), d AS (SELECT question_id, count(u.l) = count(*) AND count(g.l) = count(*) AS same FROM u FULL JOIN g USING (question_id, l, r) GROUP BY question_id),
sw AS (SELECT question_id, coalesce(max(step), 0) AS widest FROM (SELECT question_id, source_pts - lag(source_pts) OVER (PARTITION BY question_id, core_id ORDER BY source_pts) AS step FROM k) GROUP BY question_id)
SELECT question_id, same, widest FROM d JOIN sw USING (question_id)""")
def direct_unions(spark, sf):
    """Whether each user's regions are the union of the windows of their seeds, and the widest step within a core."""
    c = candidates(spark, sf)
    return reports.direct_union(cores(c).join(bounds(c), QUESTION), regions(c), QUESTION, "source_pts", RADIUS)


@query(f"""WITH {SQL_C}, x AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS a, row_number() OVER (PARTITION BY question_id ORDER BY (event_id * 7) % 97 / 97.0::DOUBLE DESC, source_pts, candidate_index) AS b FROM c),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY least(a, b), source_pts, candidate_index) AS f FROM x) WHERE f <= 16),
k AS (SELECT *, sum(o) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) AS core_id FROM (SELECT *, CASE WHEN source_pts - lag(source_pts) OVER (PARTITION BY question_id ORDER BY source_pts, candidate_index) > {GAP} THEN 1 ELSE 0 END AS o FROM s))
SELECT question_id, CAST(core_id AS BIGINT) AS core_id, count(*) AS seeds, min(source_pts) AS first, max(source_pts) AS last, arg_min(candidate_index, (-score, source_pts)) AS anchor, round(max(score), 9) AS peak FROM k GROUP BY question_id, core_id""")
def route_plans(spark, sf):
    """Cores of sixteen seeds that two routes share, with anchors by the first route's score."""
    c = candidates(spark, sf)
    two = F.explode(F.array(F.struct(F.lit("score").alias("view"), F.col("score").alias("s")), F.struct(F.lit("late").alias("view"), (F.pmod(F.col("event_id") * 7, F.lit(97)) / 97.0).alias("s"))))
    v = c.select(*ITEM, "source_pts", two.alias("v")).select(*ITEM, "source_pts", "v.*")
    seeds = ranking.fused_min(v, QUESTION, "view", ["source_pts", "candidate_index"], 16, "s")
    return pools.seed_plan(c, seeds, QUESTION, "candidate_index", "source_pts", "score", GAP).withColumn("peak", F.round("peak", 9))
