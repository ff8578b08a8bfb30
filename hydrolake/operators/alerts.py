"""Alert rows, confirmation sources and prediction feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk
from hydrolake.functions.text import alert_message, fixed1
from hydrolake.operators.timegrid import asof_join, latest_before


def alert_gate(df: DataFrame, min_level: str = config.ALERT_MIN_LEVEL, status: str = "status") -> DataFrame:
    return df.where(risk.passes_gate(status, min_level))


def first_alerts(df: DataFrame, keys: Sequence[str] = ("loc", "status"), time: str = "time") -> DataFrame:
    """The first row per (site, status). An aggregate, so repeats fold before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(time, F.hash(*rest))).alias("_a")).select(*keys, "_a.*")


def alert_messages(df: DataFrame, at: str | Column, name: str = "message") -> DataFrame:
    """Adds the alert text; needs location, status, depth_cm, reasoning, recommendation."""
    return df.withColumn(name, alert_message("location", "status", "depth_cm", "reasoning", "recommendation", at))


def hybrid_validation(
    sites: DataFrame, sar: DataFrame, radar: DataFrame, as_of: Column, by: str = "loc", sar_limit: str = "30 days", radar_limit: str = "45 minutes"
) -> DataFrame:
    """Confirmation per site at WASPADA or above: satellite water signature, else radar rain, else none.

    ``sites`` has status; ``sar`` has time, vh (dB), mode, polarisation; ``radar`` has time, alpha.
    The newest image decides.
    """
    usable = sar.where((F.col("mode") == "IW") & F.array_contains("polarisation", "VH"))
    s = latest_before(usable, as_of, sar_limit, by).select(
        by, (F.col("vh") < -18.0).alias("_wet"), F.col("time").alias("_sar_at")
    )
    r = latest_before(radar, as_of, radar_limit, by)
    # older than the limit or exactly at it does not count
    r = r.where(F.col("time") > as_of - F.expr(f"interval {radar_limit}")).select(
        by, (F.col("alpha") > 0).alias("_rain"), F.col("time").alias("_radar_at")
    )
    high = sites.where(F.col("status").isin("WASPADA", "SIAGA", "AWAS"))
    joined = high.join(s, by, "left").join(r, by, "left")
    by_sar, by_radar = F.coalesce("_wet", F.lit(False)), F.coalesce("_rain", F.lit(False))
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("_sar_at").cast("timestamp"))
    hours = micros / F.lit(3.6e9)
    return joined.select(
        *sites.columns,
        F.when(by_sar, "SATELIT").when(by_radar, "RADAR").alias("source"),
        F.when(by_sar, "TERKONFIRMASI SATELIT").when(by_radar, "TERKONFIRMASI RADAR").alias("label"),
        F.when(by_sar, F.concat(F.lit("Sentinel-1 (Real-time) ("), fixed1(hours), F.lit(" jam lalu)")))
        .when(by_radar, F.concat(F.lit("Hujan Terdeteksi ("), F.date_format("_radar_at", "HH:mm"), F.lit(")")))
        .alias("detail"),
        F.when(by_sar, "#2ecc71").when(by_radar, "#3498db").alias("color_hex"),
    )


def feedback_agreement(predictions: DataFrame, outcomes: DataFrame, limit_seconds: int = 86400, by: str = "loc") -> DataFrame:
    """Predicted level against the next reported outcome at the site, counted.

    Predictions: time, risk_level. Outcomes: time, id, actual_outcome.
    """
    met = asof_join(predictions, outcomes, limit_seconds, by, direction="forward", tie="id")
    wet = F.col("r_actual_outcome").isin("Banjir", "Air Meluap")
    warned = F.col("risk_level") != "AMAN"
    return (
        met.where(F.col("r_actual_outcome").isNotNull())
        .groupBy("risk_level", F.col("r_actual_outcome").alias("actual_outcome"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(wet == warned).alias("agree"))
    )
