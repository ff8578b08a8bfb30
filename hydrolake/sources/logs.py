"""Prediction and weather logs: row layout, append, and cleaning of hand-kept CSV logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column renames from the weather feed to the log.
WEATHER_RENAME = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "rain": "rain",
    "surface_pressure": "pressure",
    "wind_speed_10m": "wind_speed",
}
WEATHER_SOURCE = "open-meteo"


def _id(key: str | None) -> Column:
    """Log ids need no counter: the given key, else a random unique text."""
    return F.col(key) if key else F.uuid()


def prediction_rows(df: DataFrame, key: str | None = None, at: str | Column = "timestamp") -> DataFrame:
    at_col = F.col(at) if isinstance(at, str) else at
    outcome = F.col("actual_outcome") if "actual_outcome" in df.columns else F.lit(None).cast("string")
    return df.select(
        _id(key).alias("id"),
        at_col.alias("timestamp"),
        *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "rain_24h", "tide_level", "probability")],
        F.col("risk_level"),
        outcome.alias("actual_outcome"),
        at_col.alias("created_at"),
    )


def weather_rows(df: DataFrame, rename: Mapping[str, str] = WEATHER_RENAME, key: str | None = None, source: str = WEATHER_SOURCE) -> DataFrame:
    """Feed columns under their log names; absent ones are NULL."""
    return df.select(
        _id(key).alias("id"),
        "timestamp",
        *[
            (F.col(src).cast("double") if src in df.columns else F.lit(None).cast("double")).alias(dst)
            for src, dst in rename.items()
        ],
        F.lit(source).alias("source"),
    )


def append(rows: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append to a log partitioned by day, so that recent-hours queries prune folders."""
    rows.withColumn("log_date", F.to_date(time)).write.mode("append").partitionBy("log_date").parquet(path)


def append_predictions(df: DataFrame, path: str, key: str | None = None, at: str | Column = "timestamp") -> None:
    append(prediction_rows(df, key, at), path)


def append_weather(df: DataFrame, path: str, rename: Mapping[str, str] = WEATHER_RENAME, key: str | None = None) -> None:
    append(weather_rows(df, rename, key), path)


# Columns of the hand-kept history log.
HISTORY_COLUMNS = ["Waktu", "Status", "Probabilitas", "Hujan Hari Ini", "Akumulasi 3 Hari"]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history CSV with every field as text; rows with too few or too many fields keep their line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*HISTORY_COLUMNS, "_corrupt_record"]])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def clean_prediction_log(df: DataFrame) -> DataFrame:
    """Typed log rows from text: percent signs, mixed case and ragged rows.

    A row whose third field carries no percent sign has lost its probability column, so its fields
    from there on sit one place to the left.
    """
    third, fourth, fifth = F.col("Probabilitas"), F.col("Hujan Hari Ini"), F.col("Akumulasi 3 Hari")
    shifted = ~F.coalesce(F.endswith(F.trim(third), F.lit("%")), F.lit(False))
    percent = F.try_divide(F.expr("try_cast(rtrim('%', trim(Probabilitas)) as double)"), F.lit(100.0))

    def num(c: Column) -> Column:
        return c.try_cast("double")

    return df.select(
        F.col("Waktu").try_cast("timestamp_ntz").alias("waktu"),
        F.upper(F.trim("Status")).alias("status"),
        F.when(~shifted, percent).alias("probabilitas"),
        F.when(shifted, num(third)).otherwise(num(fourth)).alias("hujan_hari_ini"),
        F.when(shifted, num(fourth)).otherwise(num(fifth)).alias("akumulasi_3_hari"),
        shifted.alias("ragged"),
    )
