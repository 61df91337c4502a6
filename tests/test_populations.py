from __future__ import annotations

import pytest

from keelson.operators import contracts, pools, reports, sets, temporal


def test_frozen_manifest(spark):
    rows = [(f"q{v}-{k}", f"v{v}", "short" if v < 3 else "long", "A") for v in range(6) for k in range(3)]
    schema = "q string, v string, stratum string, answer string"
    faults = lambda rs: sorted((r["kind"], r["name"], r["expected"], r["found"]) for r in contracts.population_faults(spark.createDataFrame(rs, schema), "q", {"short": 9, "long": 9}, "stratum", "v", 3, {"answer": "ABCD"}).collect())
    assert faults(rows) == []
    assert faults(rows[:-1]) == [("group_size", "v5", 3, 2), ("stratum", "long", 9, 8)]
    assert faults([*rows[:-1], ("q0-0", "v5", "odd", "E")]) == [("group_strata", "v5", 1, 2), ("repeated", "q0-0", 1, 2), ("stratum", "long", 9, 8), ("stratum", "odd", 0, 1), ("value", "answer=E", 0, 1)]
    assert faults(rows[:9]) == [("stratum", "long", 9, 0)]


def test_requests_by_key_frame(spark):
    keys = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "v int, t long")
    asked = spark.createDataFrame([(1, 3), (1, 10), (1, 19), (1, 19), (1, 25), (2, 7), (3, 1)], "v int, t long")
    got = {(r["v"], r["key_time"]): (r["n"], list(r["times"])) for r in temporal.by_key_frame(asked, keys, ["v"], "t").collect()}
    assert got == {(1, None): (1, [3]), (1, 10): (2, [10, 19]), (1, 20): (1, [25]), (2, 5): (1, [7]), (3, None): (1, [1])}


def test_windows_must_have_room(spark):
    points = spark.createDataFrame([(1, t) for t in range(0, 50, 5)], "k int, t long")
    spans = spark.createDataFrame([(1, 0, 0, 12), (1, 1, 30, 41)], "k int, region int, left long, right long")
    quota = lambda a, b: spark.createDataFrame([(1, 0, a), (1, 1, b)], "k int, region int, quota int")
    got = temporal.inside_windows(points, spans, ["k"], "t", 10, "region", quota(3, 3))
    assert sorted((r["t"], r["region"]) for r in got.collect()) == [(0, 0), (5, 0), (10, 0), (30, 1), (35, 1), (40, 1)]
    with pytest.raises(Exception, match="quota of region 0"):
        temporal.inside_windows(points, spans, ["k"], "t", 10, "region", quota(4, 1)).collect()


def test_lookup_is_whole_or_not_at_all(spark):
    known = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (1, 10, "a"), (3, 30, "c")], "i int, t long, h string")
    bank = sets.lookup_bank(known, ["i", "t"], "h")
    want = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("y", 1, 10), ("y", 2, 21), ("z", 9, 9)], "g string, i int, t long")
    got = {(r["g"], r["i"]): (r["h"], r["complete"]) for r in sets.looked_up(want, bank, ["g"], ["i", "t"], "h").collect()}
    assert got == {("x", 1): ("a", True), ("x", 2): ("b", True), ("y", 1): (None, False), ("y", 2): (None, False), ("z", 9): (None, False)}
    with pytest.raises(Exception, match="two values"):
        sets.lookup_bank(known.union(spark.createDataFrame([(1, 10, "d")], known.schema)), ["i", "t"], "h").collect()


def test_paths_of_top_rows(spark):
    members = spark.createDataFrame([(1, r, 10 * r + i) for r in (0, 1) for i in range(6)], "q int, r int, i int")
    prefixes = spark.createDataFrame([(1, r, 10 * r + i, i + 1) for r in (0, 1) for i in range(5)], "q int, r int, i int, place int")
    quotas = spark.createDataFrame([(1, 0, "m", 3), (1, 1, "m", 2), (1, 0, "n", 1), (1, 1, "n", 4)], "q int, r int, method string, quota int")
    top = spark.createDataFrame([(1, i) for i in (0, 2, 3, 4, 5, 11)], "q int, i int")
    got = {(r["i"], r["method"]): (r["state"], r["capacity"], r["more"]) for r in reports.path_states(top, prefixes, quotas, members, ["q"], "r", "i").collect()}
    assert got == {
        (0, "m"): ("selected", 4, 0), (2, "m"): ("selected", 4, 0), (3, "m"): ("quota_reachable", 4, 1), (4, "m"): ("beyond_capacity", 4, 2), (5, "m"): ("outside_prefix", 4, None), (11, "m"): ("selected", 4, 0),
        (0, "n"): ("selected", 4, 0), (2, "n"): ("quota_reachable", 4, 2), (3, "n"): ("quota_reachable", 4, 3), (4, "n"): ("beyond_capacity", 4, 4), (5, "n"): ("outside_prefix", 4, None), (11, "n"): ("selected", 4, 0),
    }


def test_group_profile(spark):
    rows = [("a", "x", True, False, "left", 1.0), ("a", "y", True, True, "both", 3.0), ("b", "x", None, False, "none", 8.0), ("a", "x", False, True, "right", 5.0)]
    df = spark.createDataFrame(rows, "s string, t string, m boolean, n boolean, cell string, p double")
    got = {(r["s"], r["t"]): r for r in reports.group_profile(df, [["s"], ["t"], ["s", "t"], []], ["m", "n"], "cell", ["both", "left"], ["p"]).collect()}
    assert len(got) == 2 + 2 + 3 + 1
    r = got["a", "all"]
    assert (r["n"], r["right_m"], r["rate_n"], r["cell_both"], r["mean_p"], r["median_p"]) == (3, 2, pytest.approx(2 / 3), 1, 3.0, 3.0)
    assert (got["all", "all"]["median_p"], got["b", "x"]["right_m"], got["a", "x"]["cell_left"]) == (4.0, 0, 1)


def test_fine_rows_and_direct_unions(spark):
    cores = spark.createDataFrame([(1, 0, 4, 0, 10), (1, 0, 1, 8, 20), (1, 1, 2, 40, 50)], "q int, region_id int, seeds int, left long, right long")
    fine = spark.createDataFrame([(1, t, t % 2 == 0) for t in (3, 9, 15, 18, 30, 44)], "q int, t long, selected boolean")
    got = {r["region_id"]: tuple(r)[2:] for r in reports.fine_summary(cores, fine, ["q"], "t", 7).collect()}
    assert got == {0: (4, 2, 1, 1), 1: (1, 1, 1, 1)}
    seeds = spark.createDataFrame([(1, 0, 5, 0, 100), (1, 0, 9, 0, 100), (1, 1, 30, 0, 100), (2, 0, 5, 0, 100), (2, 0, 20, 0, 100)], "q int, core_id int, t long, low long, high long")
    regions = spark.createDataFrame([(1, 1, 13), (1, 26, 34), (2, 1, 24)], "q int, left long, right long")
    assert {r["q"]: (r["same"], r["widest"]) for r in reports.direct_union(seeds, regions, ["q"], "t", 4).collect()} == {1: (True, 4), 2: (False, 15)}
    pool = spark.createDataFrame([(1, i, 10 * i, s) for i, s in enumerate((0.1, 0.5, 0.5, 0.9, 0.2))], "q int, i int, t long, score double")
    chosen = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 1), (1, 4)], "q int, i int")
    plan = {r["core_id"]: (r["seeds"], r["first"], r["last"], r["anchor"], r["peak"]) for r in pools.seed_plan(pool, chosen, ["q"], "i", "t", "score", 15).collect()}
    assert plan == {0: (3, 0, 20, 1, 0.5), 1: (1, 40, 40, 4, 0.2)}
