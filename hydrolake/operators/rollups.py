"""Hourly to daily aggregates, log statistics and recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import calendar
from hydrolake.functions.numeric import clip, flag
from hydrolake.operators import series
from hydrolake.operators.series import Series


def daily_rollup(hourly: DataFrame, by: str = "loc", time: str = "time") -> DataFrame:
    """Total and peak rain, mean soil moisture per local day."""
    return hourly.groupBy(by, F.to_date(time).alias("tanggal")).agg(
        F.sum("precipitation").alias("rain_sum_imputed"),
        F.max("precipitation").alias("rain_intensity_max"),
        F.avg("soil_moisture_surface").alias("soil_moisture_surface_mean"),
        F.avg("soil_moisture_root").alias("soil_moisture_root_mean"),
    )


def upstream_lagged(upstream: DataFrame, hours: int = config.UPSTREAM_LAG_HOURS, rain: str = "upstream_precipitation", by: str = "loc", time: str = "time") -> DataFrame:
    """Upstream rain per day of arrival: each hour counts ``hours`` later."""
    arrival = F.expr(f"{time} + interval {hours} hours")
    return upstream.groupBy(by, F.to_date(arrival).alias("tanggal")).agg(F.sum(rain).alias("upstream_rain_6h"))


def daily_hydrology(hourly: DataFrame, by: str = "loc", time: str = "time", size: int = series.HOURS_PER_CHUNK) -> DataFrame:
    """All hourly-derived daily features in one grouped aggregate instead of one join each.

    The three-hour rain window runs first. The daily totals are then summed map-side per chunk.
    """
    s = Series(series.hour_index(hourly, time), by, back=2, size=size)
    s.add(_rain_3h=s.rolling("precipitation", 3))
    return s.rows().groupBy(by, F.to_date(time).alias("tanggal")).agg(
        F.max("_rain_3h").alias("rain_intensity_3h"),
        F.sum(flag(F.col("precipitation") > config.RAIN_BURST)).alias("rain_burst_count"),
        F.sum(calendar.is_night(time) * F.col("precipitation")).alias("night_rain_total"),
        F.max("wind_speed").alias("wind_speed_max"),
    )


def hour_risk(night_rain: Column, day_rain: Column) -> Column:
    """1 + 0.2 * night share of the day's rain, within 0.8 .. 1.2."""
    return clip(F.lit(1.0) + night_rain / (day_rain + F.lit(1e-5)) * F.lit(0.2), 0.8, 1.2)


def log_stats(predictions: DataFrame, weather: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("predictions").alias("name"), "n_rows").unionByName(
        weather.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("weather_records").alias("name"), "n_rows")
    )


def recent_predictions(log: DataFrame, n: int = 100, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest n rows: a per-partition top-k, then a merge."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(n)


def recent_weather(weather: DataFrame, hours: int, as_of: Column, time: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` up to the end of the table."""
    return weather.where(F.col(time) >= as_of - F.expr(f"interval {hours} hours"))


def raster_summary(cells: DataFrame, by: str, value: str = "value", flood_below: float = config.ELEVATION_LOW, nodata: float = -100.0) -> DataFrame:
    """Cells, flood-prone cells and share, lowest and mean elevation; no-data cells left out."""
    valid = cells.where(F.col(value) > nodata)
    low = F.count_if(F.col(value) < flood_below)
    return valid.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_area_px"),
        low.alias("flood_prone_px"),
        (F.lit(100.0) * low / F.count(F.lit(1))).alias("flood_prone_pct"),
        F.min(value).alias("min_elevation"),
        F.avg(value).alias("mean_elevation"),
    )


def tide_monthly(obs: DataFrame, by: str = "station", time: str = "t", value: str = "est") -> DataFrame:
    return obs.groupBy(by, F.date_format(time, "yyyy-MM").alias("bulan")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def tide_extremes(obs: DataFrame, by: str = "station", time: str = "t", value: str = "est") -> DataFrame:
    """Highest and lowest tide with their times (the first time reached) and the tidal range."""
    return obs.groupBy(by).agg(
        F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("highest_at"),
        F.max(value).alias("highest"),
        F.min_by(time, F.struct(F.col(value), F.col(time))).alias("lowest_at"),
        F.min(value).alias("lowest"),
        (F.max(value) - F.min(value)).alias("tidal_range"),
    )
