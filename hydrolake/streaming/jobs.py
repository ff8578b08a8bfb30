"""Streaming twins of the batch operators.

Readings arrive as (loc, ts, kind, value). Every ``*_frame`` function maps a streaming DataFrame to a
streaming DataFrame; ``start_*`` functions attach the sink. Watermarks bound the state, late readings
beyond them are dropped. Results equal the batch operators over the closed part of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydrolake import config
from hydrolake.functions import risk

LATENESS = "2 hours"
READING_MM = 0.25  # rain per counted unit


def read_gauges(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet readings (ts, user_id, event_type, value) landing in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # event time of a stream is a zoned timestamp; the session runs in UTC
    return reader.parquet(folder).select(
        "event_id", F.expr("user_id div 5").alias("loc"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value"
    )


def rain(readings: DataFrame) -> DataFrame:
    return readings.where((F.col("kind") == "purchase") & (F.col("value") > 0))


def hourly_frame(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hourly roll-up per location. Partial sums combine before the shuffle."""
    of = lambda k: F.when(F.col("kind") == k, F.col("value"))
    return (
        readings.withWatermark("ts", lateness)
        .groupBy("loc", F.window("ts", "1 hour"))
        .agg(F.sum(of("purchase")).alias("rain"), F.max(of("signup")).alias("wind"), F.count(F.lit(1)).alias("n"))
    )


def rolling_frame(readings: DataFrame, hours: int = 24, lateness: str = LATENESS) -> DataFrame:
    """Sliding rain total, moving on every hour.

    Built on hourly totals, so an hour's total rather than each reading is copied into the windows.
    """
    per_hour = hourly_frame(readings, lateness)
    return per_hour.groupBy("loc", F.window(F.window_time("window"), f"{hours} hours", "1 hour")).agg(
        F.sum("rain").alias("rain"), F.sum("n").alias("n")
    )


def wet_spells_frame(readings: DataFrame, gap: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Spells of rain readings no further apart than ``gap``."""
    return (
        rain(readings).withWatermark("ts", lateness).groupBy("loc", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("rain"))
    )


def wet_spell_sessions(readings: DataFrame, gap: str = "1 hour") -> DataFrame:
    """The same spells over a static table."""
    return rain(readings).groupBy("loc", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("rain"))


def alerts_frame(scored: DataFrame, min_level: str = config.ALERT_MIN_LEVEL, cooldown: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """One alert per (site, status), and the next when the cooldown has passed since it.

    The state is the time of the last alert; it goes once the watermark has left the cooldown behind.
    Columns: loc, status, ts.
    """
    wait = pd.Timedelta(cooldown)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        due = []
        for ts in pd.concat([f["ts"] for f in frames]).sort_values():  # rows past the gate only
            if last is None or ts >= last + wait:
                last = ts
                due.append(ts)
        state.update((last.value // 1000,))
        # a timeout may not lie before the watermark
        state.setTimeoutTimestamp(max(int((last + wait).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        if due:
            yield pd.DataFrame({"loc": key[0], "status": key[1], "ts": due})

    passed = scored.where(risk.passes_gate("status", min_level)).withWatermark("ts", lateness).select("loc", "status", "ts")
    return passed.groupBy("loc", "status").applyInPandasWithState(
        step, "loc long, status string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def upstream_frame(readings: DataFrame, hours: int = config.UPSTREAM_LAG_HOURS, lateness: str = LATENESS) -> DataFrame:
    """Hourly rain next to the upstream rain of ``hours`` before, 0 where it was dry there.

    Both sides are rolled up to hours first, so the stream-stream join meets one row per side. An hour
    without upstream rain comes out once the watermark shows that none can follow.
    """
    def per_hour(kind: str, shift: int, name: str) -> DataFrame:
        moved = readings.where(F.col("kind") == kind).withColumn("ts", F.col("ts") + F.expr(f"interval {shift} hours"))
        return moved.withWatermark("ts", lateness).groupBy("loc", F.window("ts", "1 hour")).agg(F.sum("value").alias(name))

    joined = per_hour("purchase", 0, "rain").join(per_hour("error", hours, "upstream_rain"), ["loc", "window"], "leftOuter")
    return joined.withColumn("upstream_rain", F.coalesce("upstream_rain", F.lit(0.0)))


def hour_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per (loc, hour) inside each Arrow batch: shrinks a busy location before the shuffle."""
    for pdf in batches:
        yield pdf.groupby(["loc", "hour"], as_index=False)["value"].sum()


def api_frame(readings: DataFrame, k: float = config.API_DECAY) -> DataFrame:
    """Running recursive index per location: (loc, hour, api) after every micro-batch.

    The index is linear in the rain, so state is one number and the hour it stands for; a late
    reading is added with the decay of its distance.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hour, api = state.get if state.exists else (None, 0.0)
        for pdf in frames:
            for h, v in zip(pdf["hour"].tolist(), pdf["value"].tolist()):
                if hour is None:
                    hour, api = h, v
                elif h >= hour:
                    hour, api = h, api * k ** (h - hour) + v
                else:
                    api += v * k ** (hour - h)
        if hour is not None:
            state.update((hour, api))
            yield pd.DataFrame({"loc": [key[0]], "hour": [hour], "api": [api]})

    hours = rain(readings).select("loc", F.floor(F.unix_micros("ts") / 3_600_000_000).cast("long").alias("hour"), "value")
    small = hours.mapInPandas(hour_sums, "loc long, hour long, value double")
    return small.groupBy("loc").applyInPandasWithState(
        step, "loc long, hour long, api double", "hour long, api double", "update", GroupStateTimeout.NoTimeout
    )


def scored_frame(readings: DataFrame) -> DataFrame:
    """Depth and status per rain reading."""
    depth = risk.formula_depth(F.col("value") * READING_MM, F.lit(config.TIDE_HIGH))
    return rain(readings).select("event_id", "loc", "ts", depth.alias("depth_cm")).withColumn("status", risk.risk_label("depth_cm"))


# --- sinks -----------------------------------------------------------------------------------


def to_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append-mode file sink; exactly once through its commit log."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def to_log(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """One folder per micro-batch, overwritten if the batch is replayed: a retry adds no rows twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def start_hourly(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_parquet(hourly_frame(readings), path, checkpoint, **trigger)


def start_rolling(readings: DataFrame, path: str, checkpoint: str, hours: int = 24, **trigger) -> StreamingQuery:
    return to_parquet(rolling_frame(readings, hours), path, checkpoint, **trigger)


def start_wet_spells(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_parquet(wet_spells_frame(readings), path, checkpoint, **trigger)


def start_api(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_log(api_frame(readings), path, checkpoint, mode="update", **trigger)


def start_log(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_log(scored_frame(readings), path, checkpoint, **trigger)


def start_alerts(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_parquet(alerts_frame(scored), path, checkpoint, **trigger)


def start_upstream(readings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return to_parquet(upstream_frame(readings), path, checkpoint, **trigger)
