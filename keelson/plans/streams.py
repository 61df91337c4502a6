"""Queries that run as streams: the table is landed in time order, read in batches until all is done, and read back."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from ..functions.ticks import Grid
from ..sources.shared import scratch_path
from ..streaming import journal, runs, state
from .registry import query
from .views import HOUR, table


def _frames(spark, sf):
    """Ticks in microseconds of each user, each once."""
    return table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("source_pts")).distinct()


_F = "f AS (SELECT DISTINCT user_id AS question_id, epoch_us(ts) AS source_pts FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY source_pts) - 1 AS row_index, min(source_pts) OVER (PARTITION BY question_id) AS start FROM f)"


@query(f"WITH {_F}, t AS (SELECT *, (source_pts - start) // {6 * HOUR} AS k FROM i), g AS (SELECT question_id, k, min(source_pts) AS source_pts, min(row_index) AS row_index FROM t GROUP BY question_id, k) SELECT question_id, coalesce(lag(k) OVER (PARTITION BY question_id ORDER BY k), -1) + 1 AS target_index, source_pts, row_index FROM g")
def grid_stream(spark, sf):
    """Rows that answer a grid of six hours from each user's first event, with the grid's state kept between batches."""
    grid = Grid.of(Fraction(1, 1_000_000), Fraction(0), Fraction(1, 6 * 3600))
    return runs.streamed(_frames(spark, sf), "source_pts", lambda s: state.grid_stream(s, "question_id", "source_pts", grid))


@query(f"WITH {_F}, t AS (SELECT *, 2 * (source_pts - start) - 5400000000 AS d FROM i), u AS (SELECT *, d // 9000000000 - CASE WHEN d % 9000000000 < 0 THEN 1 ELSE 0 END AS k FROM t), g AS (SELECT question_id, k, min(source_pts) AS source_pts, min(row_index) AS row_index FROM u WHERE k >= 0 GROUP BY question_id, k) SELECT question_id, coalesce(lag(k) OVER (PARTITION BY question_id ORDER BY k), -1) + 1 AS target_index, source_pts, row_index FROM g")
def rational_grid_stream(spark, sf):
    """The same with a phase of 45 minutes and four targets in five hours, in exact integers throughout."""
    grid = Grid.of(Fraction(1, 1_000_000), Fraction(2700), Fraction(4, 5 * 3600))
    return runs.streamed(_frames(spark, sf), "source_pts", lambda s: state.grid_stream(s, "question_id", "source_pts", grid), 7)


_LOST = 24 * HOUR


@query(
    f"WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS next, (SELECT max(epoch_us(ts)) FROM events) AS seen FROM events), "
    f"l AS (SELECT user_id, t, next FROM e WHERE next - t > {_LOST} OR (next IS NULL AND (t + {_LOST} + 999) // 1000 <= seen // 1000 - 3600000)) "
    f"SELECT user_id, 'lost' AS state, t + {_LOST} AS at_us, t AS last_us FROM l UNION ALL SELECT user_id, 'back', next, t FROM l WHERE next IS NOT NULL"
)
def worker_silence(spark, sf):
    """Users as workers that are lost after a day without a sign, by timers of the stream's own time."""
    e = table(spark, sf, "events").select("user_id", "ts")
    return runs.streamed(e, "ts", lambda s: state.silence(s, "user_id", "ts", _LOST))


@query("WITH e AS (SELECT *, round(value * 100) AS cents FROM events), p AS (SELECT event_type, event_id, row_number() OVER w AS done, sum(cents) OVER w / row_number() OVER w AS mean FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, event_id, done, mean, greatest(500 - done, 0) * mean / 4 AS eta FROM p")
def stage_progress(spark, sf):
    """Event types as stages of 500 tasks on four workers, values in whole cents as their times: mean so far and time left after each task."""
    e = table(spark, sf, "events").select("event_type", "event_id", "ts", F.round(F.col("value") * 100).alias("cents"))
    return runs.streamed(e, "ts", lambda s: state.progress(s, "event_type", "ts", "cents", "event_id", 500, 4))


@query("SELECT a.user_id, a.event_id, b.event_id AS completion_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS")
def call_completions(spark, sf):
    """Clicks as starts and purchases as completions within twelve hours: two streams joined, each side's state dropped as the other's time passes."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, "completions")
    sides = {"started": e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("started_at")), "completed": e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("completion_id"), F.col("ts").alias("completed_at"))}
    for name, df in sides.items():
        runs.land(df, f"{name}_at", f"{root}/{name}")
    a, b = (runs.follow(spark, f"{root}/{name}", df.schema) for name, df in sides.items())
    met = state.completions(a.withColumnRenamed("start_id", "event_id"), b, ["user_id"], "12 HOURS", carry=(["event_id"], ["completion_id"]))
    return runs.run_now(met.select("user_id", "event_id", "completion_id", F.round("seconds", 3).alias("seconds")), f"{root}/out", f"{root}/checkpoint")


def _answers(rows: pd.DataFrame) -> list[str]:
    return [f"{e}/{k}" for e, k in zip(rows["event_id"], rows["event_type"], strict=True)]


@query("SELECT user_id, event_type, event_id, 'completed' AS status, event_id || '/' || event_type AS answer FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def call_journal(spark, sf):
    """One call for each user and event type, made once by a write-ahead journal, 16 at a time."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    root = scratch_path(spark, "journal")
    runs.land(e, "ts", f"{root}/in")
    calls = journal.Journal(spark, f"{root}/journal", ["user_id", "event_type"], "v1")
    q = runs.follow(spark, f"{root}/in", e.schema).writeStream.foreachBatch(calls.settle(_answers, "ts")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return calls.settled().select("user_id", "event_type", "event_id", "status", "answer")
