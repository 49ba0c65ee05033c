"""Queries that run the event table as a stream, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import audit as dq
from boxloom.plans.derive import Tables, with_sql
from boxloom.plans.io import scratch
from boxloom.plans.matching import rounded
from boxloom.plans.registry import query
from boxloom.streaming import live


def stream(t: Tables):
    rows = t.spark.readStream.schema(live.FRAME_SCHEMA).parquet(f"{t.folder}/events*.parquet")
    return rows.select(
        F.col("user_id").alias("camera"), F.col("event_id").alias("frame_number"), "ts", F.col("event_type").alias("class_name"),
        "value", (F.col("value") % 1.0).alias("score"),
    )


def drained(t: Tables, df, name: str):
    folder = scratch(t, name)
    live.run_to_files(df, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("st1", "SELECT user_id AS camera, event_id AS frame_number, ts FROM events")
def deduplicated(t):
    twice = stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = live.dedup_frames(twice.select("camera", "frame_number", "ts"))
    return drained(t, out, "st1")


RECENT_SQL = with_sql("frames") + """, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ts DESC, frame_number DESC) AS k FROM frames)
  SELECT camera, count(*) AS frames, round((count(*) FILTER (k <= 120) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts) FILTER (k <= 120))) / 1e6), 9) AS rate,
    round(quantile_cont(value, 0.5) FILTER (k <= 300), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (k <= 300), 6) AS p95 FROM r GROUP BY camera"""


def _recent(df):
    return rounded(rounded(df.select("camera", "frames", "rate", "p50", "p95"), ("rate",)), ("p50", "p95"), 6)


@query("st2", RECENT_SQL)
def rates(t):
    out = drained(t, live.recent_stats(stream(t)), "st2")
    last = out.groupBy("camera").agg(F.max(F.struct("frames", "rate", "p50", "p95")).alias("s")).select("camera", "s.*")
    return _recent(last)


@query("st3", RECENT_SQL)
def rates_batch(t):
    return _recent(live.recent_stats_batch(t.frames()))


@query("st4", with_sql("frames") + """, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY camera ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY camera ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
  a AS (SELECT camera, sid, count(*) AS frames, max(ts) AS last_ts, max(ts) + INTERVAL 1 DAY AS stale_at FROM s GROUP BY camera, sid)
  SELECT camera, frames, last_ts, stale_at FROM a WHERE date_trunc('milliseconds', stale_at) <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stale(t):
    return drained(t, live.stale_sources(stream(t).select("camera", "ts"), "1 day"), "st4")


@query("st4_never", """WITH f AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1)
  SELECT c_custkey AS camera, TIMESTAMP '2024-01-01' AS started, first_ts FROM customer LEFT JOIN f ON user_id = c_custkey WHERE first_ts IS NULL OR first_ts > TIMESTAMP '2024-01-01 06:00:00'""")
def never(t):
    cameras = t.read("customer").select(F.col("c_custkey").alias("camera"), F.lit("2024-01-01").cast("timestamp").alias("started"))
    return live.never_started(cameras, t.frames(), "6 hours")


@query("st5", with_sql("frames", recursive=True) + """, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ts, frame_number) AS k FROM frames),
  w AS (SELECT camera, frame_number, ts, value, k, ts AS last, TRUE AS emit FROM r WHERE k = 1
    UNION ALL SELECT r.camera, r.frame_number, r.ts, r.value, r.k, CASE WHEN r.ts - w.last >= INTERVAL 6 HOURS THEN r.ts ELSE w.last END, r.ts - w.last >= INTERVAL 6 HOURS
      FROM w JOIN r ON r.camera = w.camera AND r.k = w.k + 1)
  SELECT camera, frame_number, ts, value FROM w WHERE emit""")
def throttled(t):
    return drained(t, live.throttle(stream(t), 6 * 3600.0), "st5")


@query("st6", with_sql("frames") + """, c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, class_name, count(*) FILTER (score >= 0.65) AS accepted, count(*) FILTER (score >= 0.25 AND score < 0.65) AS diagnostic FROM frames GROUP BY ALL)
  SELECT * FROM c WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
def counts(t):
    return drained(t, live.live_counts(stream(t), "1 hour"), "st6")


@query("st6_batch", with_sql("frames") + """ SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, class_name, count(*) FILTER (score >= 0.65) AS accepted, count(*) FILTER (score >= 0.25 AND score < 0.65) AS diagnostic FROM frames GROUP BY ALL""")
def counts_batch(t):
    return live.live_counts(t.frames(), "1 hour")


@query("st7", """WITH f AS (SELECT user_id AS camera, event_id, event_id - (event_id % 5) * 300 AS frame_number, ts, value / 10 AS pixel_std FROM events),
  p AS (SELECT *, coalesce(max(frame_number) OVER (PARTITION BY camera ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM f)
  SELECT camera, event_id, frame_number, CASE WHEN frame_number <= greatest(top, -1) THEN 'not_increasing' WHEN pixel_std < 1 THEN 'uniform' ELSE 'ok' END AS status FROM p""")
def checked_frames(t):
    s = stream(t).select(
        "camera", F.col("frame_number").alias("event_id"), (F.col("frame_number") - (F.col("frame_number") % 5) * 300).alias("frame_number"),
        "ts", (F.col("value") / 10).alias("pixel_std"),
    )
    return drained(t, live.validate_frames(s), "st7")


@query("st8", """WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, event_type = 'error' AS bad FROM events)
  SELECT run, count(*) AS rows, count(*) FILTER (bad) AS not_finite, CAST(0 AS BIGINT) AS repeated FROM e GROUP BY run""")
def runs(t):
    """Epoch rows arrive twice; the log holds each once and flags losses that are not finite."""
    loss = F.when(F.col("class_name") == "error", F.lit(float("inf"))).otherwise(F.col("value"))
    s = stream(t).select(F.col("camera").alias("run"), F.col("frame_number").alias("epoch"), "ts", loss.alias("loss"))
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    folder = scratch(t, "st8")
    live.monitor_runs(twice, f"{folder}/log", f"{folder}/checkpoint", ["loss"], {"availableNow": True}).awaitTermination()
    log = t.spark.read.schema("run bigint, epoch bigint, ts timestamp, loss double, status string").parquet(f"{folder}/log")
    return dq.check_epochs(log, ["run"], ["loss"]).select("run", "rows", "not_finite", "repeated")
