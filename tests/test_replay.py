from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import ranking, replay
from keelson.sources import tracked
from keelson.sources.shared import saved


@pytest.fixture(scope="module")
def game(spark):
    """Two regions of eight items, their cosines, and the greedy trace with its parts."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16, 5)) + 0.7
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos, support = np.clip(x @ x.T, 0, 1), rng.random(16)
    trace = []
    for r in (0, 1):
        own, chosen = range(8 * r, 8 * r + 8), [8 * r + 2]
        trace.append((r, 0, chosen[0], None, None, None))
        while len(chosen) < 5:
            near = {i: max(cos[i, c] for c in chosen) for i in own}
            best = max((i for i in own if i not in chosen), key=lambda i: support[i] * math.sqrt(1 - near[i]))
            trace.append((r, len(chosen), best, float(support[best]), float(near[best]), float(support[best] * math.sqrt(1 - near[best]))))
            chosen.append(best)
    items = saved(spark.createDataFrame([(i // 8, i, float(support[i])) for i in range(16)], "region long, item long, support double"), "items")
    sim = saved(spark.createDataFrame([(i, j, float(cos[i, j])) for i in range(16) for j in range(16)], "left long, right long, c double"), "cosines")
    return cos, support, trace, items, lambda p: p.join(sim, ["left", "right"])


TRACE = "region long, step int, item long, support double, redundancy double, score double"


def faults(spark, trace, items, similar):
    return sorted(map(tuple, replay.replay_faults(spark.createDataFrame(trace, TRACE), items, similar).select("region", "step", "fault").collect()), key=str)


def test_replay_accepts_a_true_trace_and_finds_broken_ones(spark, game):
    cos, support, trace, items, similar = game
    assert faults(spark, trace, items, similar) == []
    change = lambda k, **new: [tuple({**dict(zip(("region", "step", "item", "support", "redundancy", "score"), t, strict=True)), **new}.values()) if n == k else t for n, t in enumerate(trace)]
    assert faults(spark, change(2, score=trace[2][5] + 1e-3), items, similar) == [(0, 2, "score")]
    assert faults(spark, change(7, support=0.5, redundancy=None), items, similar) == [(1, 2, "redundancy"), (1, 2, "support")]
    assert (1, 2, "no_candidate") in faults(spark, change(7, item=3), items, similar)  # an item of the other region
    assert (0, 4, "repeated") in faults(spark, change(4, item=trace[3][2]), items, similar)
    assert faults(spark, [t for n, t in enumerate(trace) if n != 3], items, similar)[:1] == [(0, 4, "gap")] or (0, 4, "gap") in faults(spark, [t for n, t in enumerate(trace) if n != 3], items, similar)
    # a winner that wasn't the best: parts are right, but others beat it
    worst = min((i for i in range(8) if i not in [t[2] for t in trace[:5]]), key=lambda i: support[i])
    near = max(cos[worst, t[2]] for t in trace[:4])
    got = faults(spark, change(4, item=worst, support=float(support[worst]), redundancy=float(near), score=float(support[worst] * math.sqrt(1 - near))), items, similar)
    assert got and {g[2] for g in got} == {"beaten"} and {g[:2] for g in got} == {(0, 4)}


def test_margins_of_targets(spark, game):
    cos, support, trace, items, similar = game
    order = {r: [t[2] for t in trace if t[0] == r] for r in (0, 1)}
    quotas = spark.createDataFrame([(r, n, q) for r in (0, 1) for n, q in (("a", 1), ("b", 3), ("c", 5))], "region long, name string, quota int")
    got = {(r["item"], r["name"]): r for r in replay.margins(spark.createDataFrame(trace, TRACE), items, items.select("region", "item"), quotas, similar).collect()}
    assert len(got) == 48
    for i in range(16):
        chosen = order[i // 8]
        for name, q in (("a", 1), ("b", 3), ("c", 5)):
            r, place = got[i, name], chosen.index(i) if i in chosen else None
            end = "protected_anchor" if place == 0 else "selected" if place is not None and place < q else "no_open_slot" if q == 1 else "lost_at_last_slot"
            step = place if end == "selected" else q - 1 if end == "lost_at_last_slot" else None
            assert (r["end"], r["step"]) == (end, step)
            like = max(range(q), key=lambda k: cos[i, chosen[k]])
            assert r["representative"] == chosen[like] and r["cosine"] == pytest.approx(cos[i, chosen[like]])
            if step:
                score = lambda j: support[j] * math.sqrt(max(0, 1 - max(cos[j, c] for c in chosen[:step])))  # noqa: B023, E731
                assert r["target_score"] == pytest.approx(score(i)) and r["margin"] == pytest.approx(score(chosen[step]) - score(i)) and r["margin"] >= 0


def test_checked_selection_equals_rounds_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(q, i, 10 * i, bool(rng.random() < (0.0, 0.3, 0.6, 0.8)[q])) for q in range(4) for i in range(60)]
    pool = spark.createDataFrame([r[:3] for r in rows], "q int, i int, t int")
    bad = {(q, i) for q, i, _, b in rows if b}
    unfit = spark.createDataFrame(sorted(bad), "q int, i int")
    looked = []

    def inspect(chosen):
        looked.extend(map(tuple, chosen.select("q", "i").collect()))
        return chosen.join(unfit, ["q", "i"], "left_semi")

    select = lambda p: ranking.uniform_rounded(p.withColumnsRenamed({"t": "source_pts", "i": "candidate_index"}), ["q"], 7).select("q", F.col("candidate_index").alias("i"), F.col("source_pts").alias("t"))
    done, banned = replay.checked_selection(pool, ["q"], "i", select, inspect, saved)
    want, rounds, seen = [], {}, set()
    for q in range(4):
        out, turn = set(), 0
        while True:
            left = [i for i in range(60) if (q, i) not in out]
            at = sorted({int(np.rint(x)) for x in np.linspace(0, len(left) - 1, min(7, len(left)))})
            picks = [(q, left[k]) for k in at]
            seen |= set(picks)
            if not (new := set(picks) & bad):
                break
            rounds |= {p: turn for p in new}
            out, turn = out | new, turn + 1
        want += picks
    assert sorted((r["q"], r["i"]) for r in done.collect()) == sorted(want) and max(rounds.values()) > 2
    assert {(r["q"], r["i"]): r["round"] for r in banned.collect()} == rounds
    assert len(looked) == len(set(looked)) and set(looked) == seen
    with pytest.raises(ValueError, match="no fit rows"):
        replay.checked_selection(pool.where("q = 1"), ["q"], "i", select, lambda c: c, saved)


def test_one_changed_cell_names_its_table_and_partition(spark, tmp_path):
    rows = [(i, f"t{i}", i / 7, [i, i + 1], None if i % 5 == 0 else "x", b"\x00a") for i in range(60)]
    schema = "i long, `odd name` string, d double, a array<int>, n string, b binary"
    df = spark.createDataFrame(rows, schema)
    by = F.col("i") % 4
    first = saved(tracked.digests(df, "t", by), "digests")
    assert first.count() == 4 and tracked.drift(first, tracked.digests(df.repartition(7).select(*df.columns[::-1]), "t", by)).isEmpty()
    told = lambda other: sorted((r["table"], r["partition"], r["kind"]) for r in tracked.drift(first, other).collect())
    for column, value in (("odd name", F.lit("t9 ")), ("d", F.lit(9 / 7 + 1e-12)), ("a", F.array(F.lit(9), F.lit(11))), ("n", F.lit("")), ("b", F.lit(b"\x00b"))):
        assert told(tracked.digests(df.withColumn(column, F.when(F.col("i") == 9, value).otherwise(F.col(f"`{column}`"))), "t", by)) == [("t", "1", "content_changed")], column
    assert told(tracked.digests(df.where("i <> 6"), "t", by)) == [("t", "2", "rows_changed")]
    assert told(tracked.digests(df.where("i % 4 <> 3").union(df.limit(1).withColumn("i", F.lit(-5).cast("long"))), "t", F.when(F.col("i") < 0, F.lit(9)).otherwise(by))) == [("t", "3", "missing"), ("t", "9", "unexpected")]
    # values that run into each other are different rows
    two = lambda a, b: spark.createDataFrame([(a, b)], "x string, y string")
    assert tracked.digests(two("a", "bc"), "t", F.lit(0)).first()["digest"] != tracked.digests(two("ab", "c"), "t", F.lit(0)).first()["digest"]


def test_a_run_refuses_to_go_on_with_other_inputs(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(100).repartition(3).write.parquet(path)
    other = spark.range(5)

    def run():
        inputs = tracked.Inputs(spark, str(tmp_path / "manifest"))
        got = inputs.add("numbers", lambda: spark.read.parquet(path))
        inputs.add("other", lambda: other, F.col("id") % 2)
        with pytest.raises(ValueError, match="two inputs"):
            inputs.add("other", lambda: other)
        inputs.freeze()
        return inputs, got

    inputs, got = run()
    assert got.count() == 100
    inputs.verify()
    run()
    spark.range(1).write.mode("append").parquet(path)
    for f in (inputs.verify, run):
        with pytest.raises(ValueError, match=r"numbers/.*unexpected"):
            f()
