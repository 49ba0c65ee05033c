"""Monitoring of live frame and training-metric streams.

Windowed counts, duplicate removal and gap alarms are plain Structured Streaming operators. Only what
needs "the last n frames of a camera" or "the last emitted frame" keeps its own state. That state is
bounded (n entries, or one), whatever the camera sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def dedup_frames(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop a repeated (camera, frame_number) within the watermark."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["camera", "frame_number"])


def _latest(buffer: pd.DataFrame, new: pd.DataFrame, n: int) -> pd.DataFrame:
    both = pd.concat([buffer, new[["ts", "frame_number", "value"]]], ignore_index=True) if len(buffer) else new
    both = both[["ts", "frame_number", "value"]]
    return both.sort_values(["ts", "frame_number"]).tail(n)


def recent_stats(frames: DataFrame, rate_n: int = 120, latency_n: int = 300) -> DataFrame:
    """Per camera and micro-batch: arrival rate over the last ``rate_n`` frames and latency p50/p95
    over the last ``latency_n``. Chunks of a camera are merged one by one into the bounded buffer,
    so a busy camera never sits in memory as a whole."""
    keep = max(rate_n, latency_n)
    out = "camera bigint, frames bigint, last_ts timestamp, rate double, p50 double, p95 double"
    state_schema = "ts array<bigint>, frame array<bigint>, value array<double>, seen bigint"

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            ts, frame, value, seen = state.get
            buffer = pd.DataFrame({"ts": pd.to_datetime(list(ts), unit="us"), "frame_number": list(frame), "value": list(value)})
        else:
            buffer, seen = pd.DataFrame(columns=["ts", "frame_number", "value"]), 0
        for pdf in chunks:
            seen += len(pdf)
            buffer = _latest(buffer, pdf, keep)
        micros = buffer["ts"].astype("datetime64[us]").astype("int64")
        state.update((micros.tolist(), buffer["frame_number"].astype("int64").tolist(), buffer["value"].tolist(), seen))
        t = micros.tail(rate_n)
        span = (t.iloc[-1] - t.iloc[0]) / 1e6
        v = buffer["value"].tail(latency_n)
        yield pd.DataFrame({
            "camera": [key[0]], "frames": [seen], "last_ts": [buffer["ts"].iloc[-1]],
            "rate": [(len(t) - 1) / span if span > 0 else None],
            "p50": [v.quantile(0.5)], "p95": [v.quantile(0.95)],
        })

    return frames.select("camera", "ts", "frame_number", "value").groupBy("camera").applyInPandasWithState(
        update, out, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def recent_stats_batch(frames: DataFrame, rate_n: int = 120, latency_n: int = 300) -> DataFrame:
    """Batch twin of ``recent_stats`` after all frames."""
    from boxloom.operators.matching import top_per_group

    order = [F.col("ts").desc(), F.col("frame_number").desc()]
    last = top_per_group(frames, ["camera"], order, rate_n).groupBy("camera").agg(
        F.max("ts").alias("last_ts"), F.min("ts").alias("_first"), F.count("*").alias("_n")
    )
    span = (F.unix_micros("last_ts") - F.unix_micros("_first")) / 1e6
    lat = top_per_group(frames, ["camera"], order, latency_n).groupBy("camera").agg(
        F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95")
    )
    seen = frames.groupBy("camera").agg(F.count("*").alias("frames"))
    return seen.join(last, "camera").join(lat, "camera").select(
        "camera", "frames", "last_ts", F.when(span > 0, (F.col("_n") - 1) / span).alias("rate"), "p50", "p95"
    )


def stale_sources(frames: DataFrame, limit: str = "3 seconds", delay: str = "0 seconds") -> DataFrame:
    """One alarm per silence longer than ``limit``: a session of frames that stopped.

    The session closes when the watermark passes its last frame by ``limit``, which is the moment
    the camera counts as stale; ``stale_at`` is that moment.
    """
    sessions = frames.withWatermark("ts", delay).groupBy(F.session_window("ts", limit), "camera").agg(
        F.count("*").alias("frames"), F.max("ts").alias("last_ts")
    )
    return sessions.select("camera", "frames", "last_ts", F.col("session_window.end").alias("stale_at"))


def never_started(cameras: DataFrame, frames: DataFrame, grace: str = "6 seconds") -> DataFrame:
    """Registered cameras without a frame within ``grace`` of their start.

    ``cameras``: camera, started.
    """
    first = frames.groupBy("camera").agg(F.min("ts").alias("first_ts"))
    late = F.col("first_ts") > F.col("started") + F.expr(f"INTERVAL {grace}")
    j = cameras.join(first, "camera", "left")
    return j.filter(F.col("first_ts").isNull() | late).select("camera", "started", "first_ts")


def throttle(frames: DataFrame, seconds: float = 0.2) -> DataFrame:
    """Let a frame through only when the camera's last one is at least ``seconds`` older.

    State is one timestamp. A camera's rows of one micro-batch are ordered together; the trigger's
    file or byte limit bounds them.
    """
    gap = int(round(seconds * 1_000_000))

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(chunks), ignore_index=True).sort_values(["ts", "frame_number"])
        keep = []
        for i, t in zip(pdf.index, pdf["ts"].astype("datetime64[us]").astype("int64")):
            if last is None or t - last >= gap:
                keep.append(i)
                last = t
        state.update((last,))
        yield pdf.loc[keep, ["camera", "frame_number", "ts", "value"]]

    return frames.select("camera", "frame_number", "ts", "value").groupBy("camera").applyInPandasWithState(
        update, "camera bigint, frame_number bigint, ts timestamp, value double", "last bigint", "append",
        GroupStateTimeout.NoTimeout,
    )


def live_counts(
    detections: DataFrame, window: str = "1 minute", threshold: float = 0.65, floor: float = 0.25, delay: str = "0 seconds"
) -> DataFrame:
    """Detections per window and class at the threshold, and in the diagnostic band below it."""
    score = F.col("score")
    counts = detections.withWatermark("ts", delay).groupBy(F.window("ts", window), "class_name").agg(
        F.count_if(score >= threshold).alias("accepted"),
        F.count_if((score >= floor) & (score < threshold)).alias("diagnostic"),
    )
    return counts.select(F.col("window.start").alias("window_start"), "class_name", "accepted", "diagnostic")


def validate_frames(frames: DataFrame, minimum_std: float = 1.0) -> DataFrame:
    """Mark frames whose number does not increase or whose pixels are almost uniform.

    A frame number is accepted when it is above all earlier ones of its camera, so the state is one
    number. ``frames`` carry ``pixel_std``.
    """
    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        pdf = pd.concat(list(chunks), ignore_index=True).sort_values(["ts", "event_id"])
        before = pdf["frame_number"].cummax().shift(fill_value=top).clip(lower=top)
        state.update((int(max(top, pdf["frame_number"].max())),))
        status = pd.Series("ok", index=pdf.index)
        status[pdf["pixel_std"] < minimum_std] = "uniform"
        status[pdf["frame_number"] <= before] = "not_increasing"
        yield pd.DataFrame({
            "camera": pdf["camera"], "event_id": pdf["event_id"], "frame_number": pdf["frame_number"], "status": status,
        })

    return frames.select("camera", "event_id", "frame_number", "ts", "pixel_std").groupBy("camera").applyInPandasWithState(
        update, "camera bigint, event_id bigint, frame_number bigint, status string", "top bigint", "append",
        GroupStateTimeout.NoTimeout,
    )


def monitor_runs(epochs: DataFrame, path: str, checkpoint: str, values: list[str], trigger: dict):
    """Write each epoch row of a run once, tagged with whether its values are finite.

    A batch id names its own folder, so a batch replayed after a failure replaces itself. Rows of a
    run whose loss is not finite stay in the log as ``stop``.
    """
    from boxloom.functions.numeric import is_finite

    finite = F.lit(True)
    for v in values:
        finite = finite & is_finite(F.col(v))
    once = epochs.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["run", "epoch"])
    tagged = once.withColumn("status", F.when(finite, "ok").otherwise("stop"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return tagged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain the available input into Parquet files (nothing passes through the driver)."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
