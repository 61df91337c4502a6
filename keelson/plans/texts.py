"""Queries of text functions over texts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, questions, timetext
from .registry import query
from .views import table


def _signs(spark, sf):
    """Each event's time written in one of nine ways, as a sign in a picture might, and the kind of question asked of it."""
    t = F.col("ts").cast("timestamp")
    at = lambda form: F.date_format(t, form)
    hour, form = F.hour(t), F.col("event_id") % 9
    hour12 = (hour + 11) % 12 + 1
    half = F.when(hour < 12, "am").otherwise("pm")
    texts = [
        F.concat(F.lit("Opens at"), F.lpad(hour12, 2, "0"), F.lit(":"), at("mm"), F.lit(" "), F.upper(half), F.lit(" daily")),
        F.concat(at("HH:mm"), F.lit(" departure, gate "), F.col("user_id")),
        F.concat(F.lit("from "), hour, F.lit("."), at("mm"), F.lit(" and then")),
        F.concat(hour12, half, F.lit(" meds")),
        F.concat(F.lit("only $ "), hour, F.lit("."), at("mm")),
        F.concat(F.lit("cook for "), F.minute(t), F.lit(" minutes")),
        F.concat(at("HH：mm：ss"), F.lit("/"), F.col("user_id"), F.lit(":")),
        F.concat(F.minute(t) + 60, F.lit(":"), at("ss"), F.lit(" or 2.5 hrs")),
        F.concat(at("HH:mm"), F.lit(" , "), hour12, F.lit(" "), F.substring(half, 1, 1), F.lit(".m. , 99:"), at("mm")),
    ]
    text, mode = texts[0], F.when(form.isin(5, 7), "duration").otherwise("clock")
    for k, x in enumerate(texts):
        text = F.when(form == k, x).otherwise(text)
    return table(spark, sf, "events").select("event_id", text.alias("text"), mode.alias("mode"))


@query("""
WITH e AS (SELECT event_id, event_id % 9 AS form, strftime(ts, '%H') AS hh, strftime(ts, '%M') AS mm, strftime(ts, '%S') AS ss, lpad(CAST((hour(ts) + 11) % 12 + 1 AS VARCHAR), 2, '0') AS h12, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half, minute(ts) AS m FROM events),
x AS (SELECT event_id, 0 AS n, CASE form WHEN 0 THEN 'time:' || h12 || ':' || mm || ':' || half WHEN 1 THEN 'time:' || hh || ':' || mm || ':?' WHEN 2 THEN 'time:' || hh || ':' || mm || ':?' WHEN 3 THEN 'time:' || h12 || ':?:' || half
             WHEN 5 THEN 'duration:' || m || ':minute' WHEN 6 THEN 'time:' || hh || ':' || mm || ':' || ss || ':?' WHEN 7 THEN CASE WHEN m < 40 THEN 'time:' || (m + 60) || ':' || ss || ':?' ELSE 'duration:2.5:hour' END
             WHEN 8 THEN 'time:' || hh || ':' || mm || ':?' END AS key, form = 2 AS ambiguous FROM e
      UNION ALL SELECT event_id, 1, CASE form WHEN 7 THEN 'duration:2.5:hour' WHEN 8 THEN 'time:' || h12 || ':?:' || half END, false FROM e WHERE form = 8 OR (form = 7 AND m < 40))
SELECT event_id, n, key, ambiguous FROM x WHERE key IS NOT NULL
""")
def time_fields(spark, sf):
    """The times that such texts show: keys in order, and whether a point leaves one open."""
    found = _signs(spark, sf).select("event_id", F.posexplode(timetext.time_fields(F.col("text"), F.col("mode"))).alias("n", "f"))
    return found.select("event_id", "n", "f.key", "f.ambiguous")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS name, CAST(user_id AS VARCHAR) AS second, '{\"k/~\":\"' || event_type || '\"}' AS whole FROM events")
def json_pointers(spark, sf):
    """Values that JSON pointers lead to, in the events' own properties and in documents that hold them."""
    e = table(spark, sf, "events").select("event_id", "props", F.to_json(F.struct(F.array(F.col("event_id"), F.col("user_id")).alias("0"), F.struct(F.col("event_type").alias("k/~")).alias("a"))).alias("doc"))
    return e.select("event_id", parsing.pointer(F.col("props"), "/k").alias("k"), F.get_json_object(parsing.pointer(F.col("doc"), "/a"), "$['k/~']").alias("name"), parsing.pointer(F.col("doc"), "/0/1").alias("second"), parsing.pointer(F.col("doc"), "/a").alias("whole"))


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("u"), "event_type", F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss").alias("at"))


@query("""
WITH e AS (SELECT event_id, event_id % 4 AS form, 'event ' || event_type AS a, 'user ' || user_id AS b, 'neither ' || event_id AS c, 'line one' || chr(10) || '  at ' || strftime(ts, '%H:%M:%S') AS d FROM events)
SELECT event_id, 'Which is it, number ' || event_id || '?' AS question, array_to_string(CASE form WHEN 1 THEN [d, a, b, c] ELSE [a, b, c, d] END, '|') AS options, CASE form WHEN 1 THEN 'DABC' ELSE 'ABCD' END AS letters FROM e WHERE form < 3
""")
def option_problems(spark, sf):
    """Questions with four options, shown in other orders, over several lines or with line ends written out, taken apart; of every fourth an option is missing, so it is none."""
    e, form = _events(spark, sf), F.col("event_id") % 4
    a, b, c = F.concat(F.lit("event "), "event_type"), F.concat(F.lit("user "), "u"), F.concat(F.lit("neither "), F.col("event_id").cast("string"))
    d = F.concat(F.lit("line one\n  at "), "at")
    ask = F.concat(F.lit(" Which is it, number "), F.col("event_id").cast("string"), F.lit("?"))
    plain = F.concat_ws("\n", ask, F.concat(F.lit("A. "), a), F.concat(F.lit("(B) "), b), F.concat(F.lit("C)\t"), c), F.concat(F.lit(" D.  "), d, F.lit(" ")))
    other = F.concat_ws("\r\n", ask, F.concat(F.lit("D. "), d), F.concat(F.lit("A. "), a), F.concat(F.lit("B. "), b), F.concat(F.lit("C. "), c))
    text = F.when(form == 0, plain).when(form == 1, other).when(form == 2, F.replace(plain, F.lit("\n"), F.lit("\\n"))).otherwise(F.concat_ws("\n", ask, F.concat(F.lit("A. "), a), F.concat(F.lit("B. "), b)))
    found = e.select("event_id", F.inline(F.filter(F.array(questions.problem(text)), lambda p: p.isNotNull())))  # a filter over the row would read each text again
    return found.select("event_id", "question", F.array_join("options", "|").alias("options"), F.array_join("letters", "").alias("letters"))


@query("""
WITH e AS (SELECT event_id, event_id % 5 AS form, CASE event_id % 5 WHEN 0 THEN 'Alice ' ELSE '' END || event_type || ' at gate ' || user_id AS clause FROM events),
f AS (SELECT *, CASE form WHEN 0 THEN 'What time does ' WHEN 1 THEN 'At what time did ' WHEN 2 THEN 'In the video, what time does the male hero in the video ' WHEN 3 THEN 'After lunch, what time do ' ELSE 'How often does ' END AS head FROM e)
SELECT event_id, CASE WHEN form < 3 THEN clause ELSE head || clause || '?' END AS clause, CASE WHEN form < 3 THEN length(head) ELSE 0 END AS start, CASE WHEN form = 2 THEN 'the male hero in the video ' ELSE '' END AS subject, CASE form WHEN 3 THEN 'leading_condition' WHEN 4 THEN 'unsupported' END AS reason FROM f
""")
def event_clauses(spark, sf):
    """The event that a question of time asks about, as it stands in the question."""
    e, form = _events(spark, sf), F.col("event_id") % 5
    clause = F.concat(F.when(form == 0, "Alice ").otherwise(""), "event_type", F.lit(" at gate "), "u")
    head = F.when(form == 0, "What time does ").when(form == 1, "At what time did ").when(form == 2, "In the video, what time does the male hero in the video ").when(form == 3, "After lunch, what time do ").otherwise("How often does ")
    found = e.select("event_id", questions.event_clause(F.concat(head, clause, F.lit("?"))).alias("c"))
    return found.select("event_id", "c.clause", "c.start", "c.subject", "c.reason")


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS form, event_type AS t, user_id AS u FROM events)
SELECT event_id, CASE form WHEN 0 THEN '' WHEN 1 THEN 'content' WHEN 2 THEN 'content' WHEN 3 THEN 'multiline' WHEN 4 THEN 'answer,content' ELSE 'marker,content' END AS reasons,
       CASE form WHEN 1 THEN t WHEN 4 THEN 'b' WHEN 5 THEN 'b,b' ELSE '' END AS added, CASE form WHEN 2 THEN CAST(u AS VARCHAR) ELSE '' END AS missing FROM e
""")
def question_rewritings(spark, sf):
    """Whether rewritten questions keep the words of the first, as often."""
    e, form = _events(spark, sf), F.col("event_id") % 6
    ask = F.concat(F.lit("When does user’s "), "u", F.lit(" not make a "), "event_type", F.lit("?"))
    base = F.concat(F.lit("user's not make "), "event_type", F.lit(" when "), "u")
    new = F.when(form == 0, base).when(form == 1, F.concat(base, F.lit(" the "), "event_type")).when(form == 2, F.concat(F.lit("when user's not make "), "event_type")).when(form == 3, F.replace(base, F.lit(" when"), F.lit("\nwhen"))).when(form == 4, F.concat(F.lit("B) "), base)).otherwise(F.concat(F.lit("<b> "), base, F.lit(" </b>")))
    found = e.select("event_id", questions.rewriting(ask, new, F.lit(False)).alias("r"))
    return found.select("event_id", *(F.array_join(f"r.{c}", ",").alias(c) for c in ("reasons", "added", "missing")))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'counts' WHEN 1 THEN 'permutations' ELSE 'other' END AS structure, CASE WHEN event_id % 3 = 2 THEN 'B:empty_option,D:time_heading_only' ELSE '' END AS defects FROM events
""")
def option_structures(spark, sf):
    """How options are built, and which of them are empty or only headings."""
    e, form = _events(spark, sf), F.col("event_id") % 3
    ask = F.when(form == 0, "How many times?").when(form == 1, F.concat(F.lit("In which order?\n(a) "), "event_type", F.lit("\n (b) the user "), "u")).otherwise("What is shown?")
    heading = F.concat(F.lit("### From ["), "at", F.lit(" to "), "at", F.lit("]:"))
    n = F.col("event_id") % 7
    options = F.when(form == 0, F.array(F.concat(F.lit("A. "), F.col("u")), F.lit("B. 3."), n.cast("string"), F.lit("D) 12"))).when(form == 1, F.array(F.lit("A. (a)(b)"), F.lit("(b) (a)"), F.lit("C. (b)(a)."), F.lit("(a)(b)"))).otherwise(F.array(F.col("u"), F.lit("  "), F.concat(heading, F.lit(" a run")), heading))
    defects = questions.option_defects(options, F.array(*map(F.lit, "ABCD")))
    return e.select("event_id", questions.option_structure(ask, options).alias("structure"), F.array_join(F.transform(defects, lambda d: F.concat_ws(":", d["letter"], d["reason"])), ",").alias("defects"))
