from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import text as tx
from keelson.operators import contracts, ranking, sets, statistics, temporal
from keelson.sources import io
from keelson.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_top_k_breaks_ties_by_time_and_answers_in_time_order(spark):
    df = spark.createDataFrame([(1, 30, 0, 0.8), (1, 10, 1, 0.8), (1, 20, 2, 0.8), (1, 40, 3, 0.9)], "q int, source_pts long, candidate_index long, score double")
    assert [r["source_pts"] for r in ranking.top_k(df, ["q"], 3).orderBy("step").collect()] == [10, 20, 40]
    assert ranking.top_k(df, ["q"], 16).count() == ranking.uniform_rounded(df, ["q"], 16).count() == 4
    assert ranking.stable_argmax(df, ["q"], "score").first()["source_pts"] == 40


def test_sessions_need_a_gap_and_touching_windows_merge(spark):
    t = spark.createDataFrame([(1, x) for x in (0, 2, 4, 7)], "q int, t long")
    assert [r[0] for r in temporal.gap_sessions(t, ["q"], "t", 2).orderBy("t").select("core_id").collect()] == [0, 0, 0, 1]
    s = spark.createDataFrame([(1, 0, 4), (1, 4, 12), (1, 13, 14)], "q int, left long, right long")
    assert [r[0] for r in temporal.merge_intervals(s, ["q"]).orderBy("left").select("region_id").collect()] == [0, 0, 1]


def test_range_joins_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    p = [(int(rng.integers(0, 3)), int(x), i) for i, x in enumerate(rng.integers(-50, 100, 60))]
    s = [(int(rng.integers(0, 3)), int(a), int(a + rng.integers(0, 40)), i) for i, a in enumerate(rng.integers(-50, 100, 20))]
    got = temporal.range_join(spark.createDataFrame(p, "q int, t long, i int"), spark.createDataFrame(s, "q int, left long, right long, j int"), ["q"], "t", 16).select("i", "j")
    assert rows(got) == sorted(((i, j) for q, t, i in p for k, a, b, j in s if q == k and a <= t <= b), key=str)
    x, y = (spark.createDataFrame([(q, a, b, j) for q, a, b, j in s if j % 2 == m], f"q int, left long, right long, {n} int") for m, n in ((0, "a"), (1, "b")))
    got = temporal.overlap_join(x, y, ["q"], 16, "a", "b").select("a", "b", "overlap")
    want = [(u[3], v[3], min(u[2], v[2]) - max(u[1], v[1])) for u in s for v in s if u[3] % 2 == 0 and v[3] % 2 and u[0] == v[0] and max(u[1], v[1]) <= min(u[2], v[2])]
    assert rows(got) == sorted(want, key=str)


def test_backward_asof_takes_the_last_row_at_or_before(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "q int, t long, n string")
    b = spark.createDataFrame([(1, 5, 50), (1, 3, 30)], "q int, t long, v int")
    assert rows(temporal.backward_asof(a, b, ["q"], "t", ["v"]).select("n", "v")) == [("x", 50), ("y", None), ("z", None)]


def test_statistics(spark):
    df = spark.createDataFrame([("s", False)] * 50, "stratum string, correct boolean")
    r = {x["stratum"]: x for x in statistics.accuracy(df, "stratum").collect()}
    assert r["s"]["low"] == pytest.approx(0) and r["all"]["n"] == 50 and 0 < r["all"]["high"] < 0.1
    t = spark.createDataFrame([("a", True)] * 10 + [("b", False)], "task string, correct boolean")
    assert statistics.macro_average(t, "task", 2).first()["macro"] == 50 and statistics.macro_average(t, "task", 3).isEmpty()
    b = statistics.stratified_bootstrap(spark.createDataFrame([("a", 0)] * 5, "s string, d int"), "s", "d", 200).first()
    assert (b["low"], b["high"]) == (0, 0)
    c = statistics.cluster_bootstrap(spark.createDataFrame([(i % 7, "ab"[i % 2], i % 3) for i in range(60)], "c int, t string, y int"), "c", "t", "y", 300).first()
    assert c["low"] <= c["mean"] <= c["high"]


def test_sets(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "q int, i int")
    b = spark.createDataFrame([(1, 2), (1, 3)], "q int, i int")
    assert rows(sets.added_removed(a, b, ["q"], ["i"])) == [(1, 1, "removed"), (1, 3, "added")]
    assert sets.jaccard_overlap(a, b, ["q"], ["i"]).first()["jaccard"] == pytest.approx(1 / 3)
    al = spark.createDataFrame([("E1", "x", "id1"), ("e1", "y", "id2"), ("A", "global", "id3"), ("A", "x", "id4")], "label string, scope string, id string")
    ask = spark.createDataFrame([("e1", "x"), ("E1", "y"), ("a", "x"), ("none", "x")], "l string, s string")
    assert {(r["l"], r["s"]): (r["id"], r["ambiguous"]) for r in sets.resolve_alias(ask, al, "l", "s").collect()} == {("e1", "x"): ("id1", False), ("E1", "y"): ("id2", False), ("a", "x"): (None, True), ("none", "x"): (None, False)}
    assert rows(sets.incomplete(a, b, ["i"])) == [(1, "unexpected"), (3, "missing")]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0, 5, 0.5), (1, 1, 5, 0.5), (1, 3, 9, 1.1)], "q int, candidate_index long, source_pts long, score double")
    assert rows(contracts.candidate_violations(df, "q")) == [(1, 1, "time_order"), (1, 3, "index"), (1, 3, "score")]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "i int, v array<double>")
    assert rows(contracts.feature_violations(v, ["i"], "v", 2)) == [(2, "unit")]
    with pytest.raises(Exception, match="twice"):
        contracts.unique_key_join(df, df, ["q"]).collect()


CLOCKS = [
    ("10:00 AM", ["time:10:00:am"]), ("7:30pm", ["time:07:30:pm"]), ("09:24", ["time:09:24:?"]), ("School starts at8.30 and then", ["time:08:30:?"]), ("8pm meds", ["time:08:?:pm"]), ("09\uff1a24", ["time:09:24:?"]),
    ("PLEASE SUBSCRIBE", []), ("24:30", []), ("12:68 PM", []), ("$9.24", []), ("0:00 AM", []), ("13:00 PM", []), ("123:45", []), ("5:07 p.m.", ["time:05:07:pm"]), ("20 minutes", []), ("25:11", []), ("0.25", ["time:00:25:?"]),
    ("10:00:07 and 3:15pm", ["time:10:00:07:?", "time:03:15:pm"]), (None, []),
]


def test_time_fields(spark):
    get = lambda text, mode: [x["key"] for x in spark.createDataFrame([(text, mode)], "t string, m string").select(tx.time_fields(F.col("t"), F.col("m"))).first()[0]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLOCKS)], "i int, t string")
    found = {r["i"]: r for r in df.select("i", tx.time_fields(F.col("t"), F.lit("clock")).alias("x"), tx.clock_key(F.col("t")).alias("first")).collect()}
    for i, (_, keys) in enumerate(CLOCKS):
        assert [x["key"] for x in found[i]["x"]] == keys and found[i]["first"] == (keys[0] if keys else None), CLOCKS[i]
    assert found[16]["x"][0]["ambiguous"] and not found[2]["x"][0]["ambiguous"]
    assert get("20 minutes", "duration") == ["duration:20:minute"] and get("25:11", "duration") == ["time:25:11:?"] and get("0.25", "duration") == [] and get("8pm", "qualitative") == []
    modes = {"What time of day is depicted?": "qualitative", "How long does it take?": "duration", "What time do classes begin?": "clock", "How many people are there?": None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in modes], "q string").select("q", tx.question_mode(F.col("q"))).collect()} == modes


def test_grid_targets_move_past_the_row_that_answers(spark):
    rng = np.random.default_rng(7)
    rows_ = [(0, t) for t in (0, 35, 36, 41)] + [(1, int(t)) for t in sorted(rng.choice(400, 60, replace=False))]
    want = []
    for q in (0, 1):
        target = 3 if q else 0
        for t in (t for k, t in rows_ if k == q):
            if t >= target:
                want.append((q, t, (target - (3 if q else 0)) // 10))
                target += (t - target) // 10 * 10 + 10
    df = spark.createDataFrame(rows_, "q int, t long")
    got = [temporal.grid_asof(df.where(f"q = {q}"), ["q"], "t", F.lit(0), 3 * q, 10).select("q", "t", "target_index") for q in (0, 1)]
    assert rows(got[0]) == [(0, 0, 0), (0, 35, 1), (0, 41, 4)]
    assert rows(got[0].unionByName(got[1])) == sorted(want, key=str)


def test_bootstraps_equal_resampling_of_rows(spark):
    rng = np.random.default_rng(8)
    data = [(f"l{int(rng.integers(0, 3))}", int(c), float(rng.integers(-1, 2))) for c in rng.integers(0, 40, 300)]
    data = [(f"l{c % 3}", c, y) for _, c, y in data]
    df = spark.createDataFrame(data, "layer string, cluster int, y double")
    by = {}
    for layer, c, y in data:
        by.setdefault((layer, c), []).append(y)
    layered, equal = [], []
    for _ in range(3000):
        drawn = [by[k] for name in ("l0", "l1", "l2") for own in [[k for k in sorted(by) if k[0] == name]] for k in (own[i] for i in rng.integers(0, len(own), len(own)))]
        layered.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
        own = sorted(by)
        equal.append(np.mean([np.mean(by[own[i]]) for i in rng.integers(0, len(own), len(own))]))
    for out, draws, mean in (
        (statistics.layered_cluster_bootstrap(df, "layer", "cluster", "y", 3000), layered, np.mean([y for *_, y in data])),
        (statistics.equal_cluster_bootstrap(df, "cluster", "y", 3000), equal, np.mean([np.mean(v) for v in by.values()])),
    ):
        r = out.first()
        low, high = np.percentile(draws, [2.5, 97.5])
        assert r["clusters"] == len(by) and r["mean"] == pytest.approx(mean) and r["low"] == pytest.approx(low, abs=0.02) and r["high"] == pytest.approx(high, abs=0.02)
    pairs = spark.createDataFrame([(layer, int(y)) for layer, _, y in data], "layer string, d int")
    strata = {name: [y for layer, _, y in data if layer == name] for name in ("l0", "l1", "l2")}
    draws = [sum(np.sum(np.array(v)[rng.integers(0, len(v), len(v))]) for v in strata.values()) / len(data) for _ in range(3000)]
    r = statistics.stratified_bootstrap(pairs, "layer", "d", 3000).first()
    low, high = np.percentile(draws, [2.5, 97.5])
    assert r["n"] == len(data) and r["mean"] == pytest.approx(np.mean([y for *_, y in data])) and r["low"] == pytest.approx(low, abs=0.02) and r["high"] == pytest.approx(high, abs=0.02)


def test_groups_are_dealt_in_the_order_of_their_digests(spark):
    import hashlib

    names = [f"g{i}" for i in range(300)]
    place = {g: i % 7 for i, g in enumerate(sorted(names, key=lambda g: hashlib.sha256(g.encode()).hexdigest()))}
    df = spark.createDataFrame([(g, k) for g in names for k in range(2)], "g string, k int")
    assert {(r["g"], r["fold"]) for r in ranking.group_kfold(df, "g", 7, F.col("g")).collect()} == set(place.items())


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(tx.expand_ranges(F.lit("1-3, 5"))) == [1, 2, 3, 5]
    with pytest.raises(Exception, match="twice"):
        get(tx.expand_ranges(F.lit("1-3,5,2")))
    assert get(tx.strict_option(F.lit("(B)"))) == "B" and get(tx.strict_option(F.lit("b"))) is None
    assert get(tx.blank_option(F.lit("# From [0:00:12 to 0:00:14]:"))) and not get(tx.blank_option(F.lit("[00:12] he runs"))) and get(tx.blank_option(F.lit(" ")))
    assert get(tx.option_structure(F.lit("How many?"), F.lit(["1", "2"]))) == "counts"
    assert get(tx.js_divergence(F.lit([1.0, 0.0]), F.lit([0.0, 1.0]))) == pytest.approx(1)


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    path = str(tmp_path / "t")
    assert io.write_once(df, path) and not io.write_once(df, path)
    with pytest.raises(ValueError):
        io.write_once(df.limit(1), path)
    assert io.table_digest(df).first() == io.table_digest(df.orderBy(F.desc("i"))).first()
    raw = io.frame_payload({"k": 1}, [b"xy", b""])
    assert io.unframe_payload(raw)[1] == [b"xy", b""]
    for bad in (raw[:-1], raw + b"z", raw[:4]):
        with pytest.raises(ValueError):
            io.unframe_payload(bad)
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["vec"] for r in io.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    np.savez(tmp_path / "z.npz", a=np.arange(6).reshape(2, 3), b=np.float32(1.5))
    assert {(r["name"], tuple(r["shape"]), tuple(r["values"])) for r in io.read_npz(spark, str(tmp_path)).collect()} == {("a", (2, 3), (0, 1, 2, 3, 4, 5)), ("b", (), (1.5,))}
    with pytest.raises(Exception, match="finite"):
        io.finite_only(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    assert io.markdown(df).splitlines()[2] == "| 1 | a |"


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, CAST(id % 3 AS STRING) AS kind, CAST(id AS DOUBLE) AS v FROM range(100)")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.window_counts(events.read_events(spark, str(tmp_path / "in"), 1), "ts", "kind", "v", late="10 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == rows(events.window_counts(df, "ts", "kind", "v"))
    calls = spark.createDataFrame([(1, "completed"), (1, "failed"), (2, "running_may_generate"), (3, "failed")], "k int, status string")
    assert rows(events.call_states(calls, ["k"], "status")) == [(1, "reuse"), (2, "blocked"), (3, "free")]
