"""Seven-day outlook per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import calendar, risk
from hydrolake.functions.text import fixed0, format_id_date
from hydrolake.operators.timegrid import calendar_lags
from hydrolake.plans import features, scoring


def forecast_days(hourly: DataFrame, today: Column, days: int = 7, by: str = "loc", time: str = "time") -> DataFrame:
    """Daily rain, peak, tide and soil for the first ``days`` days from today, with the rain of the
    seven days before each.

    Hours outside the needed 14 days are filtered before anything is grouped.
    """
    day = F.to_date(time)
    needed = hourly.where((day >= F.date_sub(today, 7)) & (day < F.date_add(today, days)))
    daily = needed.groupBy(by, day.alias("tanggal")).agg(
        F.sum("precipitation").alias("rain_sum_imputed"),
        F.max("precipitation").alias("rain_intensity_max"),
        F.max("est").alias("pasut_msl_max"),
        F.avg("soil_moisture_surface").alias("soil_mean"),
    )
    return calendar_lags(daily, "rain_sum_imputed", 7, "rain_lag", by).where(F.col("tanggal") >= today)


def outlook_inputs(days: DataFrame, upstream: Column | None = None) -> DataFrame:
    """Sparse model input of each outlook day; the daily three-hour peak is a quarter of the day's rain."""
    rain, week = F.col("rain_sum_imputed"), [F.col(c) for c in config.LAG_FEATURES[:6]]
    total = rain
    for c in week:
        total = total + c
    return days.withColumns(
        {
            "soil_moisture_surface_mean": F.coalesce(F.col("soil_mean"), F.lit(0.5)),
            "soil_moisture_root_mean": F.coalesce(F.col("soil_mean"), F.lit(0.5)),
            "month_sin": calendar.month_sin("tanggal"),
            "month_cos": calendar.month_cos("tanggal"),
            "is_rainy_season": calendar.is_rainy_season("tanggal", config.OUTLOOK_RAINY_MONTHS),
            "is_weekend": calendar.is_weekend("tanggal"),
            "rain_cumsum_3d": rain + F.col("rain_lag1") + F.col("rain_lag2"),
            "rain_cumsum_7d": total,
            "drain_capacity_index": total / F.lit(config.DRAIN_CAPACITY_MM),
            "upstream_rain_6h": upstream if upstream is not None else F.lit(0.0),
            "rain_intensity_3h": F.when(rain > 10, rain / 4).otherwise(0.0),
        }
    ).drop("soil_mean")


def forecast_outlook(hourly: DataFrame, today: Column, days: int = 7, model=None, by: str = "loc") -> DataFrame:
    """Depth, band and card text for the next days of every site."""
    inputs = outlook_inputs(forecast_days(hourly, today, days, by))
    scored = scoring.score_rows(inputs, model, keep=[by, "tanggal"])
    return scored.select(
        by,
        "tanggal",
        format_id_date("tanggal").alias("hari"),
        "rain_sum_imputed",
        "pasut_msl_max",
        "rain_cumsum_7d",
        "api_7day",
        "rain_intensity_3h",
        "is_weekend",
        "is_rainy_season",
        "depth_cm",
        "label",
        "color",
        F.concat(F.col("label"), F.lit(" "), fixed0("depth_cm"), F.lit(" cm")).alias("kartu"),
    )


def variants(inputs: DataFrame) -> DataFrame:
    """Each outlook input under three readings: as is, tide above ground datum, low rain history."""
    lowered = F.greatest(F.lit(0.0), F.col("pasut_msl_max") - F.lit(config.TIDE_DATUM_OFFSET))
    kinds = F.explode(F.array(*[F.lit(v) for v in ("base", "datum_offset", "low_history")]))
    v = inputs.withColumn("variant", kinds)
    is_low = F.col("variant") == "low_history"
    return v.withColumns(
        {
            "pasut_msl_max": F.when(F.col("variant") == "datum_offset", lowered).otherwise(F.col("pasut_msl_max")),
            "rain_cumsum_7d": F.when(is_low, 10.0).otherwise(F.col("rain_cumsum_7d")),
            "rain_cumsum_3d": F.when(is_low, 5.0).otherwise(F.col("rain_cumsum_3d")),
        }
    )


def any_rain(hourly: DataFrame, by: str = "loc") -> DataFrame:
    """Whether a site's series has any rain; without, the outlook is driven by the tide alone."""
    return hourly.groupBy(by).agg((F.sum("precipitation") == 0).alias("all_dry"))


def status_cards(df: DataFrame) -> DataFrame:
    """Three fronts, soil card and command wording from current values."""
    return df.withColumns(
        {
            "meteo_status": risk.meteo_front("rain_24h", "upstream_recent"),
            "tide_status": risk.tide_front("tide_max"),
            "land_status": risk.land_front("soil_moisture"),
            "soil_status": risk.soil_card("soil_moisture"),
        }
    )


def what_if_scores(base: DataFrame, scenarios, keep: list[str]) -> DataFrame:
    grid = features.what_if(base, scenarios)
    return scoring.score_rows(grid, keep=["scenario", *keep])
