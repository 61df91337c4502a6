"""Queries of sinks and sources of plain files, contracts of rows, report tables and small list functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as tx
from ..functions.vectors import unit
from ..operators import contracts, pools, ranking, reports, sets
from ..sources import io
from ..sources.documents import register
from ..sources.shared import scratch_path
from .registry import query
from .views import QUESTION, SQL_C, SQL_T, SQL_V, candidates, results, table, vectors


@query("SELECT event_id, user_id, event_type, round(value, 4) AS value, props FROM events")
def event_log(spark, sf):
    """Events appended to a log of JSON lines in three writes, and read by their schema."""
    path = scratch_path(spark, "log")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    for k in range(3):
        io.append_events(e.where(F.col("event_id") % 3 == k), path)
    return io.read_json(spark, path, "event_id long, user_id long, event_type string, value double, props string", False).withColumn("value", F.round("value", 4))


@query("SELECT user_id, count(*) AS n, min(event_type) AS first, CAST(list_sort(list(DISTINCT event_type)) AS VARCHAR) AS kinds FROM events GROUP BY user_id")
def user_documents(spark, sf):
    """A JSON document of each user, published with a commit and read whole."""
    register(spark)
    path = scratch_path(spark, "documents")
    by = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    by.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.to_json(F.struct("user_id", "n", "kinds"), {"pretty": "true"}).alias("json")).write.format("json_documents").mode("append").save(path)
    back = io.read_json(spark, f"{path}/*.json", "user_id long, n long, kinds array<string>")
    return back.select("user_id", "n", F.col("kinds")[0].alias("first"), F.concat(F.lit("["), F.array_join("kinds", ", "), F.lit("]")).alias("kinds"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderstatus = 'F' AS VARCHAR) AS done FROM orders")
def order_sheet(spark, sf):
    """Orders as a table with a header, in which all values are texts."""
    path = scratch_path(spark, "sheet")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("done"))
    o.write.option("header", True).csv(path)
    return io.read_csv(spark, path, "o_orderkey string, o_orderstatus string, o_orderpriority string, done string")


@query("SELECT lang, source, count(*) AS n, sha256('{\"lang\":\"' || lang || '\",\"n\":' || count(*) || ',\"source\":\"' || source || '\"}') AS digest, true AS first, false AS second FROM documents GROUP BY lang, source")
def frozen_counts(spark, sf):
    """Counts written once; the second write finds equal rows and writes nothing. With digests of the rows."""
    path = scratch_path(spark, "frozen")
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    wrote = [io.write_once(n, path), io.write_once(n.orderBy(F.desc("n")), path)]
    return spark.read.parquet(path).select("lang", "source", "n", io.row_digest(["lang", "source", "n"]).alias("digest"), F.lit(wrote[0]).alias("first"), F.lit(wrote[1]).alias("second"))


def _payloads(parts):
    for p in parts:
        raw = [io.frame_payload({"conv": int(c), "turn": int(t)}, [r.encode(), (x or "").encode()]) for c, t, r, x in zip(p["conv_id"], p["turn"], p["role"], p["text"], strict=True)]
        back = [io.unframe_payload(x) for x in raw]
        yield p[["conv_id", "turn"]].assign(size=[len(x) for x in raw], role=[b[0].decode() for _, b in back], text=[b[1].decode() for _, b in back], header_turn=[h["turn"] for h, _ in back])


@query("""WITH c AS (SELECT conv_id, turn, role, octet_length(encode(role)) AS r, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS x FROM conversations)
SELECT conv_id, turn, CAST(8 + length('{"conv": ' || conv_id || ', "sizes": [' || r || ', ' || x || '], "turn": ' || turn || '}') + r + x AS BIGINT) AS size, role, sha256(text) AS digest, turn AS header_turn FROM c""")
def framed_turns(spark, sf):
    """Turns framed as payloads and taken apart again."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return c.mapInPandas(_payloads, "conv_id long, turn long, size long, role string, text string, header_turn long").select("conv_id", "turn", "size", "role", F.sha2("text", 256).alias("digest"), "header_turn")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def labelled_documents(spark, sf):
    """Documents with their labels, by a key that either side holds once; the documents come without columns that tell of labels."""
    d = contracts.without_labels(table(spark, sf, "documents").withColumn("quality", F.lit(9)), ["quality", "text", "source", "n_chars"])
    return contracts.unique_key_join(d, table(spark, sf, "labels"), ["doc_id"])


@query("SELECT conv_id, turn, CAST([role, CAST(turn % 2 AS VARCHAR)] AS VARCHAR) AS tags, length(text) AS n FROM conversations")
def composite_keys(spark, sf):
    """A join by three columns of which one is an array, each key once on both sides."""
    c = table(spark, sf, "conversations")
    tags = F.array(F.col("role"), (F.col("turn") % 2).cast("string")).alias("tags")
    both = contracts.unique_key_join(c.select("conv_id", "turn", tags), c.select("conv_id", "turn", tags, F.char_length("text").alias("n")), ["conv_id", "turn", "tags"])
    return both.select("conv_id", "turn", F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")).alias("tags"), "n")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'A. ' || event_type || '|B. ' || user_id WHEN 1 THEN 'A. ' || event_type || '|B. x' ELSE 'A. y|?' END AS options, printf('%.2f', user_id / 4.0::DOUBLE) || 's, ' || printf('%.2f', user_id::DOUBLE) || 's' AS times, event_id % 5 <> 0 AS free FROM events""")
def prompt_parts(spark, sf):
    """Options with their letters (none where a letter is another's), times as a list, and whether a text is free of control tokens."""
    e, form, u = table(spark, sf, "events"), F.col("event_id") % 3, F.col("user_id")
    options = F.when(form == 0, F.array(F.col("event_type"), u.cast("string"))).when(form == 1, F.array(F.concat(F.lit("A. "), "event_type"), F.lit("(B) x"))).otherwise(F.array(F.lit("y"), F.lit("A. z")))
    text = F.concat(F.lit("see "), F.when(F.col("event_id") % 5 == 0, "<image>").otherwise("this"))
    shown = F.array_join(F.transform(parsing.lettered(options), lambda x: F.coalesce(x, F.lit("?"))), "|")
    return e.select("event_id", shown.alias("options"), parsing.time_list(F.array(u / 4, u.cast("double"))).alias("times"), parsing.control_free(text).alias("free"))


_FLAWED = "f AS (SELECT question_id, event_id, candidate_index + CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END AS i, source_pts, score + CASE WHEN event_id % 41 = 0 THEN 1.5 ELSE 0 END AS score FROM c)"


@query(f"""WITH {SQL_C}, {_FLAWED}, b AS (SELECT *, row_number() OVER w - 1 AS place, lag(source_pts) OVER w AS before, max(source_pts) OVER (PARTITION BY question_id) AS high FROM f WINDOW w AS (PARTITION BY question_id ORDER BY source_pts, i))
SELECT question_id, i AS candidate_index, rule FROM (SELECT *, 'index' AS rule FROM b WHERE i <> place UNION ALL SELECT *, 'time_order' FROM b WHERE before >= source_pts UNION ALL SELECT *, 'score' FROM b WHERE score > 1 UNION ALL SELECT *, 'time_range' FROM b WHERE source_pts >= high)""")
def coarse_violations(spark, sf):
    """Candidates with planted flaws: indices, scores, and a last one that a half-open range leaves out."""
    c = candidates(spark, sf).withColumns({"candidate_index": F.col("candidate_index") + F.when(F.col("event_id") % 53 == 0, 1).otherwise(0), "score": F.col("score") + F.when(F.col("event_id") % 41 == 0, 1.5).otherwise(0.0)})
    c = c.withColumn("high", F.max("source_pts").over(Window.partitionBy("question_id")))
    return contracts.candidate_violations(c, "question_id", half_open=F.col("source_pts") < F.col("high")).select("question_id", F.col("candidate_index").cast("long").alias("candidate_index"), "rule")


@query(f"""WITH {SQL_C}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_pts, candidate_index) AS rk FROM c) WHERE rk <= 6 + question_id % 4),
s AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY source_pts) AS place FROM t), g AS (SELECT *, place + CASE WHEN question_id % 10 = 0 THEN 1 ELSE 0 END AS step FROM s)
SELECT question_id, step, rule FROM (SELECT *, 'budget' AS rule FROM g WHERE question_id IN (SELECT question_id FROM g GROUP BY question_id HAVING count(*) > 8) UNION ALL SELECT *, 'order' FROM g WHERE step <> place)""")
def selection_violations(spark, sf):
    """Selections of six to nine against a budget of eight; of every tenth user the steps are off by one."""
    c = candidates(spark, sf)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "source_pts", "candidate_index"))
    taken = c.withColumn("_r", rank).where(F.col("_r") <= 6 + F.col("question_id") % 4)
    step = F.row_number().over(Window.partitionBy("question_id").orderBy("source_pts")) + F.when(F.col("question_id") % 10 == 0, 1).otherwise(0)
    return contracts.selection_violations(taken.withColumn("step", step), "question_id", 8).select("question_id", F.col("step").cast("long").alias("step"), "rule")


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'size' ELSE 'unit' END AS rule FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 7 = 0")
def feature_violations(spark, sf):
    """Unit vectors, of which some lack their last components (as these are made unit again only their size is wrong) and some are of length two."""
    v = table(spark, sf, "embeddings")
    vec = F.when(F.col("vec_id") % 10 == 0, unit(F.slice("embedding", 1, 60))).when(F.col("vec_id") % 7 == 0, F.transform(unit(F.col("embedding")), lambda x: 2 * x)).otherwise(unit(F.col("embedding")))
    return contracts.feature_violations(v.select("vec_id", vec.alias("vec")), ["vec_id"], "vec", 64)


_M = "m AS (SELECT lang, source, round(100 * avg((n_chars % 100 < 50)::INT), 6) AS acc, sum(n_chars) AS size, round(sum(n_chars) / 1000.0::DOUBLE, 6) AS seconds FROM documents GROUP BY lang, source)"


@query(f"""WITH {_M}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY acc DESC, size, source) AS n FROM m WHERE source <> 'src1') WHERE n = 1)
SELECT m.lang, b.source AS baseline, (m.acc >= b.acc + 2 AND m.size <= 1.1 * b.size AND m.seconds <= 1.1 * b.seconds) OR (m.acc >= b.acc AND (m.size <= 0.8 * b.size OR m.seconds <= 0.8 * b.seconds)) AS passed FROM m JOIN b USING (lang) WHERE m.source = 'src1'""")
def resource_gate(spark, sf):
    """Whether one source beats the best other source of its language within its size and time, or matches it with less."""
    d = table(spark, sf, "documents").groupBy("lang", "source").agg(F.round(100 * F.avg((F.col("n_chars") % 100 < 50).cast("int")), 6).alias("acc"), F.sum("n_chars").alias("size"), F.round(F.sum("n_chars") / 1000, 6).alias("seconds"))
    return reports.resource_gate(d, ["lang"], "source", "src1", "acc", "size", "seconds")


@query(f"WITH {SQL_T}, g AS (SELECT count(*) > 100 AS enough, avg(a::INT) >= 0.5 AS better, sum(a::INT) - sum(b::INT) < 0 AS worse FROM t) SELECT enough, better, worse, enough AND better AND worse AS passed FROM g")
def decision_gates(spark, sf):
    """Thresholds on the metrics of two methods, and all of them."""
    m = results(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a").cast("int")).alias("rate"), (F.sum(F.col("a").cast("int")) - F.sum(F.col("b").cast("int"))).alias("net"))
    return reports.gates(m, {"enough": F.col("n") > 100, "better": F.col("rate") >= 0.5, "worse": F.col("net") < 0})


_OOF = f"""{SQL_T}, r AS (SELECT doc_id, doc_id % 5 AS fold, 'a' AS method, (doc_id * 7) % 101 AS score, a::INT AS correct FROM t UNION ALL SELECT doc_id, doc_id % 5, 'b', (doc_id * 13) % 97, b::INT FROM t),
s AS (SELECT fold, method, sum(correct) AS k, count(*) AS n FROM r GROUP BY fold, method), o AS (SELECT fold, method, (sum(k) OVER w - k) / (sum(n) OVER w - n)::DOUBLE AS rate FROM s WINDOW w AS (PARTITION BY method)),
f AS (SELECT fold, method AS fixed FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rate DESC, method) AS n FROM o) WHERE n = 1),
q AS (SELECT doc_id, arg_min(correct, (-score, method)) AS chosen, max(CASE WHEN method = fixed THEN correct END) AS fixed, max(correct) AS oracle FROM r JOIN f USING (fold) GROUP BY doc_id)"""


@query(f"WITH {_OOF} SELECT count(*) AS n, CAST(sum(chosen) AS BIGINT) AS chosen, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(oracle) AS BIGINT) AS oracle FROM q")
def out_of_fold(spark, sf):
    """Right answers of a choice by score, of the method that is best outside a document's fold, and of the better one each time."""
    t = results(spark, sf)
    one = lambda m, a, b: t.select("doc_id", (F.col("doc_id") % 5).alias("fold"), F.lit(m).alias("method"), (F.col("doc_id") * a % b).alias("score"), F.col(m).cast("int").alias("correct"))
    return reports.out_of_fold(one("a", 7, 101).unionByName(one("b", 13, 97)), "doc_id", "fold", "method", "score", "correct")


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END END AS label, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END END AS o FROM labels)
SELECT coalesce(o, label, 'pending') AS label, count(*) AS n, round(avg(CASE WHEN label = o THEN 1.0 WHEN label <> o THEN 0.0 END), 6) AS agreement FROM l GROUP BY 1""")
def annotation_counts(spark, sf):
    """Counts of labels where a second reading goes before the first, and how often both agree."""
    l_ = table(spark, sf, "labels")
    first = l_.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("label"))
    second = l_.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("label"))
    return reports.annotations(first, second, ["doc_id"]).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {SQL_V}, p AS (SELECT region, i, avg(e[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY region, i), q AS (SELECT region, list(m ORDER BY i) AS m, sqrt(sum(m * m)) AS n FROM p GROUP BY region) SELECT region, round(m[1] / n, 6) AS first, round(m[64] / n, 6) AS last, len(m) AS size FROM q")
def mean_vectors(spark, sf):
    """The mean vector of each region, at length one."""
    m = reports.mean_vectors(vectors(spark, sf), ["region"], "embedding")
    return m.select("region", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"), F.size("embedding").cast("long").alias("size"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'open' WHEN toxic = 1 THEN 'drifted' ELSE 'completed' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def recovery_states(spark, sf):
    """Documents whose result is there, is of another protocol, or is open."""
    have = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "old").otherwise("new").alias("protocol"))
    return reports.recovery(have, table(spark, sf, "documents"), ["doc_id"], "protocol", "new")


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) UNION ALL SELECT doc_id + 1000000, 'unexpected' FROM labels WHERE doc_id % 2 = 1")
def incomplete_labels(spark, sf):
    """Documents without a label, and labels without a document, after every second label's id is shifted away."""
    l_ = table(spark, sf, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 1, 1_000_000).otherwise(0)).alias("doc_id"))
    return sets.incomplete(l_, table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query(f"""WITH {SQL_C}, k AS (SELECT * FROM c WHERE event_id % 4 = 0), n AS (SELECT question_id, count(*) AS n FROM k GROUP BY question_id), i AS (SELECT question_id, source_pts, row_number() OVER (PARTITION BY question_id ORDER BY source_pts) - 1 AS candidate_index FROM k),
f AS (SELECT DISTINCT question_id, source_pts FROM c WHERE event_id % 4 IN (0, 1)), x AS (SELECT f.* FROM f ANTI JOIN k USING (question_id, source_pts))
SELECT question_id, candidate_index, source_pts, 'coarse' AS origin FROM i UNION ALL SELECT question_id, coalesce(n, 0) - 1 + row_number() OVER (PARTITION BY question_id ORDER BY source_pts), source_pts, 'fine' FROM x LEFT JOIN n USING (question_id)""")
def appended_pool(spark, sf):
    """A coarse pool with fine rows after it: the coarse row of a time goes before the fine one, and fine rows are numbered on."""
    c = candidates(spark, sf)
    coarse = c.where("event_id % 4 = 0").select("question_id", "source_pts").withColumn("candidate_index", (F.row_number().over(Window.partitionBy("question_id").orderBy("source_pts")) - 1).cast("long"))
    both = coarse.select("question_id", "source_pts", F.lit(0).alias("from")).unionByName(c.where("event_id % 4 IN (0, 1)").select("question_id", "source_pts", F.lit(1).alias("from")))
    fine = sets.first_wins(both, ["question_id", "source_pts"], [F.col("from")]).where(F.col("from") == 1).drop("from")
    return pools.appended(coarse, fine, QUESTION, "source_pts").select("question_id", "candidate_index", "source_pts", "origin")


@query(f"WITH {SQL_C}, p AS (SELECT *, row_number() OVER (PARTITION BY question_id, event_type ORDER BY score DESC, source_pts, candidate_index) AS step FROM c) SELECT question_id, event_type, step, candidate_index FROM p WHERE step <= 1 + (question_id + length(event_type)) % 4")
def cut_prefixes(spark, sf):
    """Prefixes by user and type, cut at a quota of each."""
    c = candidates(spark, sf)
    p = c.withColumn("step", F.row_number().over(Window.partitionBy("question_id", "event_type").orderBy(F.desc("score"), "source_pts", "candidate_index")))
    q = c.select("question_id", "event_type").distinct().withColumn("quota", 1 + (F.col("question_id") + F.char_length("event_type")) % 4)
    return pools.cut_prefixes(p, q, ["question_id", "event_type"]).select("question_id", "event_type", "step", "candidate_index")


@query("WITH d AS (SELECT DISTINCT lang, doc_id, CASE WHEN n_chars % 3 = 0 THEN 'long' WHEN n_chars % 3 = 1 THEN 'odd' ELSE 'plain' END AS kind FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE kind WHEN 'odd' THEN 1 WHEN 'long' THEN 2 ELSE 3 END, doc_id) AS place FROM d) SELECT lang, doc_id, kind, CAST(place AS INTEGER) AS place FROM p WHERE place <= 12")
def review_queue(spark, sf):
    """Twelve documents of each language to review, odd ones first."""
    d = table(spark, sf, "documents").select("lang", "doc_id", F.when(F.col("n_chars") % 3 == 0, "long").when(F.col("n_chars") % 3 == 1, "odd").otherwise("plain").alias("kind"))
    return ranking.review_queue(d, "lang", ["odd", "long"], "kind", "doc_id", 12)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u,t,m' WHEN 1 THEN 't,m,u' ELSE 'm,u,t' END AS methods, CAST(range(user_id + 1, user_id + 4) || [user_id + 9] AS VARCHAR) AS numbers FROM events")
def rotations_and_ranges(spark, sf):
    """Methods begun at an event's ordinal, and numbers of an expression of ranges."""
    u = F.col("user_id")
    said = F.concat((u + 1).cast("string"), F.lit(" - "), (u + 3).cast("string"), F.lit(", "), (u + 9).cast("string"))
    numbers = F.concat(F.lit("["), F.array_join(F.transform(tx.expand_ranges(said), lambda x: x.cast("string")), ", "), F.lit("]"))
    return table(spark, sf, "events").select("event_id", F.array_join(ranking.rotated(F.array(*map(F.lit, "utm")), F.col("event_id")), ",").alias("methods"), numbers.alias("numbers"))


@query("WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) SELECT a.item_id AS item_id, b.item_id AS other, len(list_filter(b.w[1:2], lambda x: NOT list_contains(a.w, x))) = 0 AS covered FROM w a JOIN w b ON length(CAST(a.item_id AS VARCHAR)) = length(CAST(b.item_id AS VARCHAR)) AND a.w[1] = b.w[1]")
def literal_matches(spark, sf):
    """Of items that begin with the same word, whether one holds the first two words of the other."""
    plain = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    w = table(spark, sf, "benchmark").select("item_id", plain.alias("w"))
    a, b = w.select("item_id", "w", F.get("w", F.lit(0)).alias("k")), w.select(F.col("item_id").alias("other"), F.slice("w", 1, 2).alias("g"), F.get("w", F.lit(0)).alias("k"))
    met = a.join(b, "k").where(F.length(F.col("item_id").cast("string")) == F.length(F.col("other").cast("string")))
    return met.select("item_id", "other", tx.literal_cover(F.col("g"), F.col("w")).alias("covered"))
