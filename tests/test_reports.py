from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import hashing, parsing
from keelson.functions import text as tx
from keelson.operators import learning, matching, pools, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pools(spark):
    c = spark.createDataFrame([(1, i, 10 * i) for i in range(5)], "q int, candidate_index int, source_pts long")
    left = pools.exclude(c, c.where("candidate_index = 1"), ["q"])
    assert rows(left.select("original_index", "candidate_index")) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    t = spark.createDataFrame([(1, x, r) for x, r in ((11, 40), (12, 40), (20, 40), (26, 27), (95, 99))], "q int, target long, right long")
    f = spark.createDataFrame([(1, x) for x in (15, 20, 28)], "q int, source_pts long")
    added, status = pools.fine_pool(c, t, f, ["q"], "source_pts")
    assert rows(status.select("target", "status")) == [(11, "added"), (12, "duplicate_source"), (20, "duplicate_source"), (26, "outside_window"), (95, "no_source")]
    assert rows(pools.appended(c, added, ["q"], "source_pts").where("origin = 'fine'")) == [(1, 5, 15, "fine")]
    q = spark.createDataFrame([(1, 0, 3, 9), (1, 1, 2, 1), (1, 2, 9, 9)], "q int, region_id long, size int, want int")
    assert rows(pools.feasible_quotas(q, ["q"], F.lit(6), "size", "want")) == [(1, 0, 3), (1, 1, 1), (1, 2, 2)]
    m = spark.createDataFrame([(1, ["a", " "]), (2, ["a", "b"]), (3, ["# From [0:00:12 to 0:00:20]:"])], "i int, o array<string>")
    assert rows(pools.masked_questions(m, "o", tx.blank_option).select("i", "excluded")) == [(1, True), (2, False), (3, True)]


def test_reports(spark):
    df = spark.createDataFrame([("s", "x", 1), ("s", "y", 0), ("t", "x", 1)], "a string, b string, k int")
    assert rows(reports.profile(df, [["a"], ["b"], []], {"n": F.count(F.lit(1)), "k": F.sum("k")})) == [("all", "all", 3, 2), ("all", "x", 2, 2), ("all", "y", 1, 0), ("s", "all", 2, 1), ("t", "all", 1, 1)]
    w = spark.createDataFrame([("c", True, False), ("c", None, False)], "cat string, m1 boolean, m2 boolean")
    assert rows(reports.common_failures(w, ["m1", "m2"], "cat")) == [("c", 2, 1, 1, 2)]
    o = spark.createDataFrame([(q, q % 2, m, float((q + k) % 3), (q + k) % 2 == 0) for q in range(6) for k, m in enumerate("ab")], "q int, f int, m string, s double, c boolean")
    r = reports.out_of_fold(o, "q", "f", "m", "s", "c").first()
    assert r["n"] == r["oracle"] == 6 and r["chosen"] <= 6 and r["fixed"] == 0
    g = spark.createDataFrame([("base", 50.0, 100.0, 10.0), ("new", 52.0, 105.0, 10.5)], "m string, acc double, size double, sec double").withColumn("p", F.lit(1))
    assert reports.resource_gate(g, ["p"], "m", "new", "acc", "size", "sec").first()["passed"]
    assert not reports.gates(g.limit(1), {"x": F.col("acc") > 1, "y": F.lit(None).cast("boolean")}).first()["passed"]
    lab = spark.createDataFrame([(1, "good"), (2, None), (3, "bad")], "i int, label string")
    over = spark.createDataFrame([(3, "good")], "i int, label string")
    assert {x["label"]: x["n"] for x in reports.annotations(lab, over, ["i"]).collect()} == {"good": 2, "pending": 1}
    v = spark.createDataFrame([(1, [3.0, 0.0]), (1, [3.0, 8.0])], "i int, v array<double>")
    assert reports.mean_vectors(v, ["i"], "v").first()["v"] == pytest.approx([0.6, 0.8])
    c = spark.createDataFrame([(1, 10.0, 9.5, None), (2, 10.0, 5.0, 1.0), (3, 1.0, 1.0, 1.0)], "i int, total double, a double, b double")
    assert rows(reports.cost_closure(c, ["i"], "total", ["a", "b"]).select("i")) == [(2,), (3,)]
    res = spark.createDataFrame([(1, "p"), (2, "old")], "i int, fp string")
    assert rows(reports.recovery(res, spark.createDataFrame([(1,), (2,), (3,)], "i int"), ["i"], "fp", "p")) == [(1, "completed"), (2, "drifted"), (3, "open")]
    top = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "q int, i int")
    assert {x["macro"] for x in reports.retention(top.where("i = 1"), top, ["q"], "i").collect()} == {0.75}


def test_matching(spark):
    p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 2, 0.7), (3, 3, 0.4), (3, 4, 0.4), (5, 5, 0.0)], "a int, b int, v double").withColumn("k", F.lit(0))
    assert rows(matching.mutual_best(p, ["k"], "a", "b", "v").select("a", "b")) == [(1, 1), (2, 2)]
    s = spark.createDataFrame([(1, t, v, i) for i, (t, v) in enumerate([(0, 0.9), (3, 0.8), (10, 0.7), (20, 0.0), (30, 0.2)])], "q int, t long, s double, i int")
    assert rows(matching.suppressed(s, ["q"], "t", "s", "i", 4, 2).select("i", "step")) == [(0, 1), (2, 2)]


def test_set_value_head_learns_and_its_slopes_are_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4, 6))
    mask = np.arange(4)[None, :] < rng.integers(1, 5, 40)[:, None]
    labels, question = (x[:, 0, 0] > 0).astype(int), np.arange(40) // 4
    head = learning.SetValueHead(6, (5, 4), seed=2)
    loss = lambda: learning.preference_loss(head.forward(x, mask)[0], labels, question)[0]
    s, kept = head.forward(x, mask)
    grads = head.backward(learning.preference_loss(s, labels, question)[1], kept)
    for k, at in (("w1", (2, 3)), ("w2", (1, 2)), ("w3", (5,)), ("b1", (1,))):
        head.p[k][at] += 1e-5
        up = loss()
        head.p[k][at] -= 2e-5
        assert grads[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        head.p[k][at] += 1e-5
    trained = learning.train(x, mask, labels, question, epochs=30)
    after = learning.preference_loss(trained.forward(x, mask)[0], labels, question)[0]
    assert after < learning.preference_loss(learning.SetValueHead(6).forward(x, mask)[0], labels, question)[0] / 2
    assert sum(v.size for v in learning.SetValueHead(770).p.values()) == 107_073
    assert learning.choose(np.array([1.0, 1.0 + 1e-9, 0.5]), np.array([1, 0, 2])) == 1


def test_parsing(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(parsing.lettered(F.lit(["x", "B. y", "A. z"]))) == ["A. x", "B. y", None]
    assert get(parsing.time_list(F.lit([0.0, 1.25]))) == "0.00s, 1.25s"
    assert not get(parsing.control_free(F.lit("a <image> b"))) and get(parsing.control_free(F.lit("a b")))
    assert parsing.joined_words("Straße C# it's") == ["strasse", "c#", "it's"] and parsing.plain_words("Élan 2") == ["elan", "2"]
    assert parsing.normal_text("  STATE  A ") == "state a"
    assert parsing.strict_object('{"a": 1}', {"a": int}) == ({"a": 1}, "ok")
    assert [parsing.strict_object(t, {"a": str}, {"a": ["x"]})[1] for t in ("{", "[]", "{}", '{"a": 1}', '{"a": "y"}')] == ["not_json", "not_object", "fields", "types", "vocabulary"]
    doc = F.lit('{"a/b": [1, {"~": 2, "it\'s": "x"}], "0": null, "": {"01": true}}')
    ways = {"/a~1b/1/~0": "2", "/a~1b/1/it's": '"x"', "/0": "null", "//01": "true", "/a~1b/01": None, "/a~1b/-": None, "/a~1b/2": None, "/a~1b/x": None, "/no": None, "//01/0": None}
    assert {w: get(parsing.pointer(doc, w)) for w in ways} == ways
    assert get(parsing.pointer(F.lit("[1]"), "")) == "[1]" and get(parsing.pointer(F.lit("{"), "")) is None
    for bad in ("a", "/~2", "/~"):
        with pytest.raises(ValueError, match="pointer"):
            parsing.pointer(doc, bad)


def test_perceptual_hash_ignores_brightness():
    g = np.random.default_rng(3).random((32, 32))
    h = hashing.perceptual_hash(g)
    assert h == hashing.perceptual_hash(g * 2 + 5) and h >> 63 == 0 and bin(h).count("1") > 20
