from __future__ import annotations

import os
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from keelson.functions.ticks import Grid
from keelson.streaming import journal, runs, state

FRAMES = "video string, tick long"


def answered(ticks, base, phase, rate):
    """Rows that answer targets, by the definition, in fractions."""
    out, target = [], phase
    for n, t in enumerate(ticks):
        at = (t - ticks[0]) * base
        if at >= target:
            out.append(((target - phase) * rate, t, n))
            while target <= at:
                target += 1 / rate
    return [(int(k), t, n) for k, t, n in out]


@pytest.mark.parametrize("base,phase,rate", [(Fraction(1, 8), Fraction(1, 4), Fraction(1)), (Fraction(1001, 30000), Fraction(0), Fraction(2)), (Fraction(1, 3), Fraction(2, 7), Fraction(5, 11))])
def test_grid_of_fractions(base, phase, rate, spark):
    grid = Grid.of(base, phase, rate)
    ticks = range(-5, 400)
    want = [((t + 3) * base - phase) * rate // 1 for t in ticks]
    assert [grid.reached(t, -3) for t in ticks] == want
    got = spark.createDataFrame([(t,) for t in ticks], "t long").select("t", grid.reached(F.col("t"), F.lit(-3)).alias("k")).collect()
    assert [r["k"] for r in sorted(got)] == want
    for bad in ((0, 0, 1), (1, -1, 1), (1, 0, 0)):
        with pytest.raises(ValueError, match="grid"):
            Grid.of(*map(Fraction, bad))


def test_grid_state_across_batches_and_a_restart(spark, tmp_path):
    videos = {"a": [i + i // 17 for i in range(360)], "b": [1000 + 3 * i for i in range(90)], "c": [2**40, 2**40 + 1, 2**40 + 900], "d": [7]}
    base, phase, rate = Fraction(1, 8), Fraction(1, 4), Fraction(1)
    rows = [(v, t, i * 360 // len(ts)) for v, ts in videos.items() for i, t in enumerate(ts)]
    path = str(tmp_path / "in")
    job = lambda: state.grid_stream(runs.follow(spark, path, spark.createDataFrame([], FRAMES).schema), "video", "tick", Grid.of(base, phase, rate))
    for lo, hi in ((0, 1), (1, 100), (100, 101), (101, 250)):
        spark.createDataFrame([r[:2] for r in rows if lo <= r[2] < hi][::-1] or [], FRAMES).coalesce(1).write.mode("append").parquet(path)
    first = runs.run_now(job(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).count()
    spark.createDataFrame([r[:2] for r in rows if r[2] >= 250], FRAMES).coalesce(1).write.mode("append").parquet(path)
    got = runs.run_now(job(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = sorted((v, *x) for v, ts in videos.items() for x in answered(ts, base, phase, rate))
    assert sorted(map(tuple, got.select("video", "target_index", "tick", "row_index").collect())) == want and 0 < first < len(want)
    # a tick that doesn't rise ends the stream, in a batch or between batches
    spark.createDataFrame([("b", 1000)], FRAMES).write.mode("append").parquet(path)
    with pytest.raises(StreamingQueryException, match="doesn't follow"):
        runs.run_now(job(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def test_grid_state_is_one_row_a_bucket_whatever_its_keys(spark, tmp_path):
    rows = [(None if k == 40 else f"k{k}", 5 * k + i * (1 + k % 3)) for k in range(41) for i in range(k % 5 + 1, 30)]
    base, phase, rate = Fraction(1, 8), Fraction(1, 4), Fraction(1)
    path = str(tmp_path / "in")
    runs.land(spark.createDataFrame(rows, FRAMES), "tick", path, 3)
    found = state.grid_stream(runs.follow(spark, path, spark.createDataFrame([], FRAMES).schema), "video", "tick", Grid.of(base, phase, rate), buckets=3)
    with state.state_store(spark):
        q = found.writeStream.format("memory").queryName("grid_buckets").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    ticks = {}
    for v, t in rows:
        ticks.setdefault(v, []).append(t)
    want = [(v, *x) for v, ts in ticks.items() for x in answered(sorted(ts), base, phase, rate)]
    assert sorted(map(tuple, spark.table("grid_buckets").collect()), key=str) == sorted(want, key=str)


def test_lost_workers_appear_when_their_timer_fires(spark, tmp_path):
    start, path = datetime(2024, 1, 1), str(tmp_path / "in")
    schema = "worker string, at timestamp"
    minute = 60_000_000

    def told(*signs):
        spark.createDataFrame([(w, start + timedelta(minutes=m)) for w, m in signs], schema).coalesce(1).write.mode("append").parquet(path)
        out = runs.run_now(state.silence(runs.follow(spark, path, spark.createDataFrame([], schema).schema), "worker", "at", 30 * minute, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        zero = spark.createDataFrame([(start,)], "t timestamp").select(F.unix_micros("t")).first()[0]
        return sorted((r["worker"], r["state"], (r["at_us"] - zero) // minute, (r["last_us"] - zero) // minute) for r in out.collect())

    assert told(("a", 0), ("b", 1), ("c", 2)) == []
    assert told(("b", 20)) == []
    # nothing of a or c comes any more: time itself, by b's signs, tells
    assert told(("b", 40)) == [("a", "lost", 30, 0), ("c", "lost", 32, 2)]
    assert told(("c", 41), ("b", 42)) == [("a", "lost", 30, 0), ("c", "back", 41, 2), ("c", "lost", 32, 2)]
    # a silence that starts and ends within one batch, and one told once only
    assert told(("b", 50), ("b", 99), ("b", 100)) == sorted([("a", "lost", 30, 0), ("c", "back", 41, 2), ("c", "lost", 32, 2), ("c", "lost", 71, 41), ("b", "lost", 80, 50), ("b", "back", 99, 50)])


def test_starts_that_nothing_completes(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    a = [(1, at(0)), (2, at(0)), (1, at(5)), (3, at(500))]
    b = [(1, at(7)), (2, at(11)), (9, at(3)), (3, at(501)), (9, at(900))]
    for name, rows in (("started", a), ("completed", b)):
        df = spark.createDataFrame(rows, f"task long, {name}_at timestamp")
        runs.land(df, f"{name}_at", str(tmp_path / name), 3)
    side = lambda n: runs.follow(spark, str(tmp_path / n), spark.createDataFrame([], f"task long, {n}_at timestamp").schema)
    met = state.completions(side("started"), side("completed"), ["task"], "10 MINUTES", "1 minute", "leftOuter")
    got = runs.run_now(met, str(tmp_path / "out"), str(tmp_path / "checkpoint")).select("task", "seconds").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 120.0), (1, 420.0), (2, None), (3, 60.0)]


def test_running_totals_do_not_depend_on_batches(spark, tmp_path):
    rows = [("s" if i % 3 else "t", i, datetime(2024, 1, 1) + timedelta(minutes=i * 7 % 101), float(i * 13 % 17)) for i in range(101)] + [(None, 500, datetime(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "stage string, task long, at timestamp, took double")
    for cuts in (1, 5):
        got = runs.streamed(df, "at", lambda s: state.progress(s, "stage", "at", "took", "task", 40, 2), cuts).collect()
        want = []
        for stage in "st":
            done = sorted((r for r in rows if r[0] == stage), key=lambda r: (r[2], r[1]))
            spent = 0.0
            for n, r in enumerate(done, 1):
                spent += r[3]
                want.append((stage, r[1], n, spent / n, max(40 - n, 0) * (spent / n) / 2))
        assert sorted(map(tuple, got)) == sorted(want)


CALLS = "q long, method string, at long, text string"


def counted(folder):
    """A call that leaves a file for each row that it was made for, and one for each flush."""

    def call(rows):
        for q, m in zip(rows["q"], rows["method"], strict=True):
            with open(os.path.join(folder, f"{q}-{m}"), "a") as f:
                f.write("x")
        if (rows["text"] == "bad").any():
            raise RuntimeError("no answer")
        return [t.upper() for t in rows["text"]]

    return call


def test_calls_are_made_once(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    rows = [(i, "m", i, f"t{i}") for i in range(70)] + [(3, "m", 99, "again"), (3, "n", 99, "other"), (None, "m", 1, "x")]
    batch = spark.createDataFrame(rows, CALLS).coalesce(1)
    j = journal.Journal(spark, str(tmp_path / "j"), ["q", "method"], "p1")
    run = j.settle(counted(str(made)), "at")
    run(batch, 0)
    got = j.settled()
    assert got.count() == 71 and got.where("status = 'completed'").count() == 71 and got.where("q = 3 AND method = 'm'").first()["answer"] == "T3"
    sizes = sorted(r["count"] for r in got.groupBy("flush").count().collect())
    assert sizes == [7, 16, 16, 16, 16]
    run(batch, 0)  # the stream stopped before it noted the batch: Spark runs it again
    run(spark.createDataFrame([*rows[:9], (500, "m", 5, "new")], CALLS), 1)
    assert j.settled().count() == 72 and {p.read_text() for p in made.iterdir()} == {"x"}

    # killed between its start and its end: what may have been made isn't made again, then or later
    late = spark.createDataFrame([(i, "k", i, "t") for i in range(600, 640)], CALLS)
    with pytest.raises(Exception, match="answers each"):
        j.settle(lambda r: [], "at")(late, 2)
    run(late, 2)
    run(late, 3)
    got = j.settled()
    assert got.where("method = 'k'").count() == 40 and got.where("method = 'k' AND status = 'uncertain'").count() == 40
    assert not [p for p in made.iterdir() if p.name.endswith("-k")]

    # a call that fails takes its flush with it, no other
    run(spark.createDataFrame([(i, "f", i, "bad" if i == 20 else "t") for i in range(40)], CALLS).coalesce(1), 4)
    got = {r["q"]: r["status"] for r in j.settled().where("method = 'f'").collect()}
    assert {q for q, s in got.items() if s == "uncertain"} == set(range(16, 32)) and len(got) == 40

    asked = spark.createDataFrame([(1, "m"), (20, "f"), (601, "k"), (9999, "m")], "q long, method string")
    assert {r["q"]: (r["action"], r["answer"]) for r in journal.actions(asked, j.settled(), ["q", "method"]).collect()} == {1: ("reuse", "T1"), 20: ("blocked", None), 601: ("blocked", None), 9999: ("free", None)}
    with pytest.raises(ValueError, match="protocol"):
        journal.Journal(spark, str(tmp_path / "j"), ["q", "method"], "p2").settle(counted(str(made)), "at")(batch, 5)


def test_journal_of_a_stream_that_goes_on(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    path, j = str(tmp_path / "in"), journal.Journal(spark, str(tmp_path / "j"), ["q", "method"], "p1")

    def go():
        s = runs.follow(spark, path, spark.createDataFrame([], CALLS).schema)
        s.writeStream.foreachBatch(j.settle(counted(str(made)), "at")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    for lo in (0, 10):
        spark.createDataFrame([(i, "m", i, "t") for i in range(lo, lo + 20)], CALLS).coalesce(1).write.mode("append").parquet(path)
        go()
    go()
    assert j.settled().count() == 30 and {p.read_text() for p in made.iterdir()} == {"x"} and len(list(made.iterdir())) == 30
