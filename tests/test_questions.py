from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelson.functions import questions as q


@pytest.fixture(scope="module")
def get(spark):
    def run(column, *values):
        schema = ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for i, v in enumerate(values[0]))
        df = spark.createDataFrame([(n, *v) for n, v in enumerate(values)], "n int, " + schema)
        rows = {r["n"]: r["x"] for r in df.select("n", column(*(F.col(f"c{i}") for i in range(len(values[0])))).alias("x")).collect()}
        return [rows[n] for n in range(len(values))]

    return run


@pytest.mark.parametrize("newline", ["\n", "\\n", "\r\n", "\\r\\n"])
def test_options_in_any_order_and_over_lines(get, newline):
    text = newline.join([" What changes?", "D. Fourth", "(A) First", "  and more", "B) Second", "C. Third "])
    (r,) = get(q.problem, (text,))
    assert (r["question"], r["options"], r["letters"]) == ("What changes?", ["Fourth", "First\n  and more", "Second", "Third"], ["D", "A", "B", "C"])


def test_other_texts_are_no_problems(get):
    bad = ["Question\nA. One\nB. One\nC. Three\nD. Four", "Question\nA. One\nA. Two\nC. Three\nD. Four", "Question\nA. One\nB. Two\nC. Three", "\nA. One\nB. Two\nC. Three\nD. Four", "Q\nA. One\nB. Two\nC. Three\nD.Four", "Q\nA.\nB. Two\nC. Three\nD. Four", "Q\nA. 1\nB. 2\nC. 3\nD. 4\nA. 5", "", None, "Q\nA] 1\nB. 2\nC. 3\nD. 4"]
    assert get(q.problem, *((b,) for b in bad)) == [None] * len(bad)


def test_rewritings(get):
    ask = "How many 5 people are not running before the bell?"
    rows = [(ask, t, cut) for t, cut in (("5 many not running before bell", False), (" ", False), ("5 many not running\nbefore bell", False), ("5 many not running before bell", True), ("<b>5</b> not running before bell", False), ("A. 5 many not running before bell", False), ("Query : 5 many not running before bell", False), ("6 many running before bell bell", False), ("[B] 5 many not running before bell", False))]
    got = get(q.rewriting, *rows)
    assert [r["reasons"] for r in got] == [[], ["empty", "content"], ["multiline"], ["truncated"], ["marker", "content"], ["answer"], ["answer", "content"], ["content"], ["marker", "content"]]
    assert got[0]["query"] == "5 many not running before bell" and all(r["query"] == ask for r in got[1:])
    assert got[7]["added"] == ["6", "bell"] and got[7]["missing"] == ["5", "not"]
    (r,) = get(q.rewriting, ("Whose dog’s is it?", "dog's", False))
    assert r["reasons"] == []


def test_option_structure(get):
    perm = "Order?\n (a) he runs\n(b) he eats\n(c) he sleeps"
    rows = [
        ("How many dogs?", ["A. 1", "B. 12", "3.", "D) 4"]), ("How many dogs?", ["1", "2", "3", "four"]), ("How long?", ["1", "2", "3", "4"]), ("Show manyfold how manyx", ["1", "2", "3", "4"]), ("Tell me, HOW MANY?", ["1", "2", "3", "4"]),
        (perm, ["A. (a)(b)(c)", "(b) (c) (a).", "(c)(b)(a)", "(a)(c)(b)"]), (perm, ["(a)(b)(c)", "(a)(b)", "(c)(b)(a)", "(a)(c)(b)"]), (perm, ["(a)(b)(c)", "(a)(b)(b)", "(c)(b)(a)", "(a)(c)(b)"]), (perm, ["(a)(b)(c)", "x(a)(b)(c)", "(c)(b)(a)", "(a)(c)(b)"]),
        ("Order?\n(a) x\n(a) y", ["(a)(a)"] * 4), ("Order? (a) x (b) y", ["(a)(b)"] * 4),
    ]
    assert get(q.option_structure, *rows) == ["counts", "other", "other", "other", "counts", "permutations", "other", "other", "other", "other", "other"]


@pytest.mark.parametrize(
    "question,clause",
    [
        ("What time does the hero in the video get up in real life?", "get up in real life"), ("What time does the male protagonist in the video go out to relax?", "go out to relax"), ("What time did the heroine in the video turn off her alarm clock?", "turn off her alarm clock"),
        ("In the video, at what time do classes begin at the boys' school?", "classes begin at the boys' school"), ("At what time does the protagonist in the video typically visit the gym for their workout?", "typically visit the gym for their workout"),
        ("What time does Alice leave after the first bell?", "Alice leave after the first bell"), ("According to the video, what  time does Alice leave ? ", "Alice leave"), ("What time does the hero leave?", "the hero leave"),
    ],
)
def test_event_clauses(get, question, clause):
    (r,) = get(q.event_clause, (question,))
    assert r["clause"] == clause == question[r["start"] : r["end"]] and r["reason"] is None
    assert r["subject"] == (question[r["start"] - len(r["subject"]) : r["start"]])


def test_questions_that_stay_whole(get):
    lead = [p + "at what time does the green model appear?" for p in ("In the last model gathering, ", "At the end of the video, ", "Before sunrise, ")]
    other = ["How many athletes cross the finish line?", "How long should one wait before cracking the knuckle?"]
    got = get(q.event_clause, *((x,) for x in lead + other))
    assert [(r["clause"], r["start"], r["end"], r["reason"]) for r in got] == [(x, 0, len(x), "leading_condition") for x in lead] + [(x, 0, len(x), "unsupported") for x in other]
    for blank in ("", "  "):
        with pytest.raises(Exception, match="question is needed"):
            get(q.event_clause, (blank,))


def test_option_defects(get):
    cases = {"": True, "   ": True, "##### From [0:03:50 to 0:04:00]:": True, "## FROM [12:03:50.5 to 12:04:00.25]: ": True, "From [0:03:50 to 0:04:00]: an actual action": False, "##### From [0:03:50 to 0:04:00]: an answer": False, "A scene from [0:03:50 to 0:04:00]": False, "####### From [0:03:50 to 0:04:00]:": False, "# From [0:3:50 to 0:04:00]:": False, "# From [ 0:03:50 to 0:04:00 ] :": True, "# From [0:03:50]:": False}
    got = get(q.option_defects, *(([t, "two", "three", "four"], ["D", "A", "B", "C"]) for t in cases))
    for (text, bad), r in zip(cases.items(), got, strict=True):
        assert [(d["letter"], d["option"]) for d in r] == ([("D", text)] if bad else []), text
    assert [d["reason"] for d in got[0] + got[2]] == ["empty_option", "time_heading_only"]


def test_facts(get):
    good = '{"visible_text": ["STOP", " a "], "observations": []}'
    rows = [(good, False), (f"```json\n{good}\n```", False), (good, True), ("{", False), ('{"visible_text": []}', False), ('{"visible_text": [1], "observations": []}', False), ('{"visible_text": ["a", "b", "c", "d"], "observations": []}', False), ('{"visible_text": [" "], "observations": []}', False), (f"so: {good}", False), ('{"visible_text": [], "observations": "x"}', False), ('{"visible_text": ["a", null], "observations": []}', False), ("[]", False), (f"```\n{good}", False), ('{"visible_text": [], "observations": [], "more": 1}', False)]
    got = get(q.facts, *rows)
    assert [r["reason"] for r in got] == [None, None, "truncated", "not_json", "shape", "shape", "list", "list", "not_json", "shape", "list", "shape", "not_json", "shape"]
    assert (got[0]["visible_text"], got[0]["observations"], got[0]["strict"]) == (["STOP", " a "], [], True)
    assert got[1]["valid"] and got[1]["fenced"] and not got[1]["strict"] and all(r["visible_text"] == [] and not r["valid"] for r in got[2:])


def test_object_queries(get):
    ask, options = "Who is biking with two dogs' owner?", ["the red ball", "Cats", "a person walking", "none"]
    say = lambda known, *choices: (f'{{"known": {known}, "choices": [{", ".join(choices or ["[]"] * 4)}]}}'.replace("'", '"'), ask, options)
    rows = [
        say("['Bicycle', 'two dogs', 'a dog', 'bicycle ']", "['red BALL']", "['cat', 'cats']", "[]", "['none']"), say("['car']"), say("[]", "['cat']", "[]", "[]", "[]"), say("['a','a','a','a','a','a','a']"), say("[]", "['a','the','red','ball']", "[]", "[]", "[]"),
        say("[' ']"), say("['" + "a " * 41 + "']"), say("[]", "[]", "[]", "[]"), say("[1]"), ("no", ask, options), say("['12']"), ('{"known": [], "choices": [[], [], [], []], "x": 1}', ask, options),
    ]
    got = get(q.object_queries, *rows)
    assert [r["reason"] for r in got] == [None, "word", "word", "bound", "bound", "phrase", "phrase", "shape", "shape", "not_json", "word", "shape"]
    assert got[0]["known"] == ["bicycle", "two dogs", "a dog"] and got[0]["choices"] == [["red ball"], ["cat", "cats"], [], ["none"]] and got[1]["choices"] == [[]] * 4


@pytest.mark.parametrize("made,sign,most", [(q.event_clause, "concat(", 2), (lambda x: q.facts(x, F.lit(False)), "concat(", 2), (q.problem, "regexp_replace(", 10), (lambda x: q.object_queries(x, F.lit("a"), F.array(*map(F.lit, "abcd"))), "try_variant_get(", 4)])
def test_a_text_is_worked_out_once(spark, made, sign, most):
    """Functions inside lambdas share nothing by themselves: what is used twice must be bound, or each use works it out anew."""
    df = spark.range(1).select(made(F.concat(F.col("id").cast("string"), F.lit("?"))))
    assert df._jdf.queryExecution().analyzed().toString().count(sign) <= most
