"""Training tables, versions 1 to 7."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import calendar, risk
from hydrolake.functions.numeric import clip, decayed, flag, unit_hash
from hydrolake.operators import rolling, rollups, series
from hydrolake.operators.ranking import dedupe
from hydrolake.operators.series import INDEX, Series


def _indexed(daily: DataFrame, date: str, by: str) -> DataFrame:
    """Row numbers of daily rows; a year of days is a fair bucket."""
    return series.row_index(daily, date, by, bucket=F.trunc(date, "year"))


def class_labels(df: DataFrame, status: str = "status_siaga") -> DataFrame:
    """label 0/1/2 (NULL for an unknown status) and the binary flood-risk flag."""
    label = F.lit(None).cast("int")
    for name, value in config.STATUS_LABELS.items():
        label = F.when(F.col(status) == name, F.lit(value)).otherwise(label)
    return df.withColumn("label", label).withColumn("is_flood", F.when(F.col("label").isNotNull(), flag(F.col("label") >= 1)))


def label_left_join(labels: DataFrame, daily: DataFrame, by: Sequence[str] = ("loc", "tanggal")) -> DataFrame:
    """Every label row with that day's hydrology, if any."""
    return labels.join(daily, list(by), "left")


def join_reports(daily: DataFrame, reports: DataFrame, flag_column: str = "is_banjir", by: Sequence[str] = ("loc", "tanggal")) -> DataFrame:
    """Every day with its report; no report counts as safe."""
    return daily.join(reports.select(*by, flag_column), list(by), "left").withColumn(
        flag_column, F.coalesce(F.col(flag_column), F.lit(0))
    )


def interaction_columns(rain="rain_sum_imputed", tide="pasut_msl_max") -> dict[str, Column]:
    flags = risk.threshold_flags(tide, rain)
    return {
        "tide_rain_interaction": F.col(tide) * F.col(rain),
        "soil_saturation_index": (F.col("soil_moisture_surface_mean") + F.col("soil_moisture_root_mean")) / 2,
        "is_high_tide": flags["is_high_tide"],
        "is_heavy_rain": flags["is_heavy_rain"],
    }


def dataset_v1(daily: DataFrame, by: str = "loc", date: str = "tanggal", k: float = config.API_DECAY) -> DataFrame:
    """Eight columns: rain, duration, tide and slope, three lags, recursive index; lag-1 tide back-filled.

    ``daily``: curah_hujan_mm, durasi_hujan_jam, pasut_msl_max. Missing rain or duration counts as 0.
    """
    filled = daily.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("curah_hujan_mm", "durasi_hujan_jam")})
    indexed = _indexed(filled, date, by)
    s = Series(indexed, by, back=3)
    s.add(
        pasut_slope=s.diff("pasut_msl_max", 1),
        **{f"hujan_lag{k_}": F.coalesce(s.lag("curah_hujan_mm", k_), F.lit(0.0)) for k_ in (1, 2, 3)},
    )
    # the index column is kept for the two operators that follow
    lagged = s.df.where(series.OWN).drop(series.CHUNK, series.OWN)
    with_api = series.recursive_index(lagged.withColumn("_keep", F.col(INDEX)), "curah_hujan_mm", k, "hujan_3days", by)
    return series.backfill_first(with_api.withColumnRenamed("_keep", INDEX), "pasut_msl_max", "pasut_max_lag1", by)


def dataset_v0(daily: DataFrame, by: str = "loc", date: str = "tanggal") -> DataFrame:
    """Four columns: rain, duration, yesterday's rain, strict three-day total; incomplete rows dropped."""
    s = Series(_indexed(daily, date, by), by, back=2)
    s.add(hujan_kemarin=s.lag("curah_hujan_mm", 1), hujan_akumulasi_3hari=s.rolling("curah_hujan_mm", 3, min_rows=3))
    return s.rows().na.drop()


def dataset_v2(labels: DataFrame, hourly: DataFrame, by: str = "loc") -> DataFrame:
    """Labelled days with daily rain and soil from the hourly archive."""
    return label_left_join(labels, rollups.daily_rollup(hourly, by), (by, "tanggal"))


def dataset_v3(daily: DataFrame, by: str = "loc", date: str = "tanggal") -> DataFrame:
    """14 features: seven lags, three-hour proxy, finite index."""
    s = Series(_indexed(daily, date, by), by, back=7)
    s.add(**{f"hujan_lag{i}": F.coalesce(s.lag("rain_sum_imputed", i), F.lit(0.0)) for i in range(1, 8)})
    s.add(
        rain_rolling_3h=F.col("rain_intensity_max") * 3,
        api_7day=decayed([F.col("rain_sum_imputed"), *[F.col(f"hujan_lag{i}") for i in range(1, 8)]], config.API_DECAY),
    )
    return s.rows()


def _labelled_days(daily: DataFrame, by: str, date: str, order: Sequence[str | Column] | None) -> DataFrame:
    rest = [c for c in daily.columns if c not in (by, date)]
    return class_labels(dedupe(daily, [by, date], order or [F.col(c) for c in rest])).na.drop(subset=["label"])


def _add_v4_windows(s: Series, exclude_current: bool) -> None:
    s.add(
        **{f"rain_lag{i}": F.coalesce(s.lag("rain_sum_imputed", i), F.lit(0.0)) for i in range(1, 8)},
        rain_cumsum_3d=s.rolling("rain_sum_imputed", 3),
        rain_cumsum_7d=s.rolling("rain_sum_imputed", 7),
    )
    rolling.add_flood_history(s, 30, exclude_current)


def _add_v6_windows(s: Series, indexed: DataFrame) -> None:
    saturation = (F.col("soil_moisture_surface_mean") + F.col("soil_moisture_root_mean")) / 2
    s.add(soil_saturation_trend=s.diff(saturation, 3), rainfall_acceleration=s.diff("rain_intensity_max", 1))
    s.run_length("consecutive_rain_days", F.coalesce(F.col("rain_sum_imputed") > 0, F.lit(False)), indexed)


def _v4_columns(df: DataFrame, date: str) -> DataFrame:
    cal = calendar.calendar_columns(date)
    return df.withColumns(
        {
            **interaction_columns(),
            "api_7day": decayed([F.col("rain_sum_imputed"), *[F.col(c) for c in config.LAG_FEATURES]], config.API_DECAY),
            **{c: cal[c] for c in ("month_sin", "month_cos", "is_rainy_season", "is_weekend")},
        }
    )


def _join_events(df: DataFrame, hourly: DataFrame, upstream: DataFrame | None, by: str, date: str) -> DataFrame:
    events = rollups.daily_hydrology(hourly, by).withColumnRenamed("tanggal", date)
    joined = df.join(events, [by, date], "left")
    if upstream is not None:
        arrived = rollups.upstream_lagged(upstream, by=by).withColumnRenamed("tanggal", date)
        joined = joined.join(arrived, [by, date], "left")
    else:
        joined = joined.withColumn("upstream_rain_6h", F.lit(0.0))
    rain = F.col("rain_sum_imputed")
    joined = joined.withColumns(
        {
            "tide_rain_sync": risk.threshold_flags("pasut_msl_max", rain)["tide_rain_sync"],
            "hour_risk_factor": rollups.hour_risk(F.col("night_rain_total"), rain),
            "drain_capacity_index": clip(F.col("rain_cumsum_7d") / F.lit(config.DRAIN_CAPACITY_MM), 0, 2),
        }
    ).drop("night_rain_total")
    amounts = [c for c in config.EVENT_FEATURES if c != "tide_rain_sync"]
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in amounts})


def dataset_v4(daily: DataFrame, by: str = "loc", date: str = "tanggal", exclude_current: bool = True, order: Sequence[str | Column] | None = None) -> DataFrame:
    """25 features. One row per day is kept, days without a known label are dropped.

    ``exclude_current=False`` lets the flood history count the day's own label (target leakage).
    ``order`` decides which of several rows of a day stays.
    """
    s = Series(_indexed(_labelled_days(daily, by, date, order), date, by), by, back=30)
    _add_v4_windows(s, exclude_current)
    return _v4_columns(s.rows(), date).select(by, date, *config.FEATURES_V4, "label", "status_siaga")


def add_v6_features(v4: DataFrame, hourly: DataFrame, upstream: DataFrame | None, by: str = "loc", date: str = "tanggal") -> DataFrame:
    """Ten event features on top of a stored 25-feature table."""
    indexed = _indexed(v4, date, by)
    s = Series(indexed, by, back=3)
    _add_v6_windows(s, indexed)
    return _join_events(s.rows(), hourly, upstream, by, date)


def dataset_v6(daily: DataFrame, hourly: DataFrame, upstream: DataFrame | None, by: str = "loc", date: str = "tanggal", exclude_current: bool = True, order: Sequence[str | Column] | None = None) -> DataFrame:
    """35 features. The windows of both steps run in one pass over the day series; hourly values come
    through one aggregate and one join."""
    indexed = _indexed(_labelled_days(daily, by, date, order), date, by)
    s = Series(indexed, by, back=30)
    _add_v4_windows(s, exclude_current)
    _add_v6_windows(s, indexed)
    full = _join_events(_v4_columns(s.rows(), date), hourly, upstream, by, date)
    return full.select(by, date, *config.FEATURES_V6, "label", "status_siaga")


# Base depth range in cm per class.
BASE_DEPTH_CM = {0: (0, 0), 1: (10, 30), 2: (50, 100)}


def depth_target(df: DataFrame, keys: Sequence[str] = ("loc", "tanggal"), noise: bool = True, by_label: bool = True, seed: int = 42, digits: int = 1) -> DataFrame:
    """Synthetic depth: class base + 2 * rain intensity + 20 * tide excess, +-5 cm noise on wet rows.

    Noise and base are drawn from a hash of the row's key, so any partitioning gives the same table.
    ``by_label=False`` starts every class at 0 (the published training table does). ``noise=False``
    uses the lowest base of the class and no noise.
    """
    base = F.lit(0.0)
    if by_label:
        u = unit_hash(*keys, seed=seed, salt="base")
        for label, (lo, hi) in BASE_DEPTH_CM.items():
            drawn = F.floor(F.lit(lo) + u * F.lit(hi - lo + 1)).cast("double") if noise else F.lit(float(lo))
            base = F.when(F.col("label") == label, drawn).otherwise(base)
    shake = unit_hash(*keys, seed=seed, salt="noise") * F.lit(10.0) - F.lit(5.0) if noise else None
    depth = risk.formula_depth("rain_intensity_max", "pasut_msl_max", base, shake)
    return df.withColumns(
        {"water_depth_cm": F.bround(depth, digits), **{c: F.lit(v) for c, v in config.STATIC_DEFAULTS.items()}}
    )


def dataset_v7(v6: DataFrame, by: str = "loc", date: str = "tanggal", **options) -> DataFrame:
    return depth_target(v6, (by, date), **options).select(
        by, date, "water_depth_cm", *config.FEATURES_V7, "label", "status_siaga"
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns in order, each once, without the excluded ones."""
    from pyspark.sql.types import NumericType

    return list(dict.fromkeys(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude))
