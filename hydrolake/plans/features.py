"""Feature tables: 37 model features per hour, per day and per sparse input row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import calendar, risk
from hydrolake.functions.numeric import clip, decayed, flag, total
from hydrolake.operators import series
from hydrolake.operators.series import Series

HOURLY_BACK = 192  # eight days: the seventh calendar lag reaches 191 hours back


def _or_default(df: DataFrame, column: str, default: float) -> Column:
    return F.col(column) if column in df.columns else F.lit(default)


def open_hourly(
    hourly: DataFrame, by: str = "loc", time: str = "time", size: int = series.HOURS_PER_CHUNK, ahead: int = 0, extra_back: int = 0
) -> tuple[Series, DataFrame]:
    """Chunked view of a dense hourly table, with its day number leading the sort."""
    indexed = series.hour_index(hourly, time).withColumn("_day", calendar.day_number(time))
    return Series(indexed, by, back=HOURLY_BACK + extra_back, ahead=ahead, size=size, day="_day"), indexed


def add_hourly_features(s: Series, indexed: DataFrame, time: str = "time") -> Series:
    """All 37 features in one shuffle: every window shares partitioning and sort order."""
    df, rain, tide = s.df, F.col("precipitation"), F.col("est")
    surface, root = _or_default(df, "soil_moisture_surface", 0.4), _or_default(df, "soil_moisture_root", 0.4)
    s.add(soil_saturation_index=(surface + root) / 2)
    s.add(
        wind_speed_max=s.rolling("wind_speed", 24, F.max) if "wind_speed" in df.columns else F.lit(0.0),
        rain_sum_imputed=s.rolling(rain, 24),
        rain_intensity_3h=s.rolling(rain, 3),
        _smooth=s.rolling(rain, 3, F.avg),
        soil_saturation_trend=s.diff("soil_saturation_index", 72),
        **{f"rain_lag{k}": F.coalesce(s.day_total(rain, k), F.lit(0.0)) for k in range(1, 8)},
    )
    s.add(
        rain_cumsum_3d=s.stacked_sum("rain_sum_imputed", 24, 3),
        rain_cumsum_7d=s.stacked_sum("rain_sum_imputed", 24, 7),
        rainfall_acceleration=s.diff("_smooth", 1),
    )
    s.count_last(24, rain_burst_count=rain > config.RAIN_BURST)
    s.run_length("_wet_hours", F.coalesce(rain > 0, F.lit(False)), indexed)
    # what needs no window comes last, so that the windows carry narrow rows
    day_rain = F.col("rain_sum_imputed")
    return s.add(
        rain_intensity_max=rain,
        pasut_msl_max=tide,
        soil_moisture_surface_mean=surface,
        soil_moisture_root_mean=root,
        upstream_rain_6h=_or_default(df, "upstream_precipitation", 0.0),
        rain_burst_count=F.col("rain_burst_count").cast("double"),
        consecutive_rain_days=F.col("_wet_hours") / F.lit(24.0),
        api_7day=decayed([day_rain, *[F.col(c) for c in config.LAG_FEATURES]], config.API_DECAY),
        tide_rain_interaction=tide * day_rain,
        **risk.threshold_flags(tide, day_rain),
        month_sin=calendar.month_sin(time),
        month_cos=calendar.month_cos(time),
        is_rainy_season=calendar.is_rainy_season(time),
        is_weekend=calendar.is_weekend(time),
        prev_flood_30d=F.lit(0),
        prev_meluap_30d=F.lit(0),
        hour_risk_factor=calendar.night_factor(time),
        drain_capacity_index=clip(F.col("rain_cumsum_7d") / F.lit(config.DRAIN_CAPACITY_MM), 0, 2),
        **{c: F.lit(v) for c, v in config.STATIC_DEFAULTS.items()},
    )


def hourly_features(hourly: DataFrame, by: str = "loc", time: str = "time", size: int = series.HOURS_PER_CHUNK) -> DataFrame:
    """The 37 model features for every hour of a dense series."""
    s, indexed = open_hourly(hourly, by, time, size)
    s = add_hourly_features(s, indexed, time)
    return s.rows().select(by, time, *config.FEATURES_V7)


# --- sparse input ------------------------------------------------------------------------------


def chain(df: DataFrame, *names: str, default: float | None = 0.0) -> Column:
    """First of the named columns that the table has; the default only if it has none of them.

    As in a keyed lookup, a column that is present but NULL stays NULL.
    """
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(default)


def filled_chain(df: DataFrame, *names: str, default: float = 0.0) -> Column:
    """Like ``chain`` but per row: the first non-null value, then the default."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


def daily_features(df: DataFrame, keep: Sequence[str] = (), per_row: bool = False) -> DataFrame:
    """The 37 features from a sparse daily input; absent columns take the standard defaults.

    ``per_row`` also fills NULLs inside present columns.
    """
    pick = filled_chain if per_row else chain
    rain = pick(df, "rain_sum_imputed", "rain_rolling_24h")
    intensity = pick(df, "rain_intensity_max")
    tide = pick(df, "pasut_msl_max")
    surface = pick(df, "soil_moisture_surface_mean", default=0.45)
    root = pick(df, "soil_moisture_root_mean", default=0.45)
    lags = [pick(df, f"rain_lag{i}", f"hujan_lag{i}") for i in range(1, 8)]

    def given(name: str, fallback: Column) -> Column:
        if name not in df.columns:
            return fallback
        return F.coalesce(F.col(name), fallback) if per_row else F.col(name)

    week = given("rain_cumsum_7d", total([rain, *lags[:6]]))
    plain = {"month_sin": 0, "month_cos": 1, "is_rainy_season": 1, "is_weekend": 0, "prev_flood_30d": 0,
             "prev_meluap_30d": 0, "rain_burst_count": 0, "soil_saturation_trend": 0, "consecutive_rain_days": 0,
             "hour_risk_factor": 1, "upstream_rain_6h": 0, "wind_speed_max": 0, "rainfall_acceleration": 0,
             **config.STATIC_DEFAULTS}
    columns = {
        "rain_sum_imputed": rain,
        "rain_intensity_max": intensity,
        "soil_moisture_surface_mean": surface,
        "soil_moisture_root_mean": root,
        "soil_saturation_index": (surface + root) / 2,
        "pasut_msl_max": tide,
        **dict(zip(config.LAG_FEATURES, lags)),
        "rain_cumsum_3d": given("rain_cumsum_3d", rain + lags[0] + lags[1]),
        "rain_cumsum_7d": week,
        "tide_rain_interaction": tide * rain,
        **risk.threshold_flags(tide, rain),
        "api_7day": decayed([rain, *lags], config.API_DECAY),
        "rain_intensity_3h": given("rain_intensity_3h", intensity * 3),
        # not clipped here, unlike in the hourly series
        "drain_capacity_index": given("drain_capacity_index", week / F.lit(config.DRAIN_CAPACITY_MM)),
        **{name: given(name, F.lit(float(v))) for name, v in plain.items()},
    }
    return df.select(*keep, *[columns[f].cast("double").alias(f) for f in config.FEATURES_V7])


def legacy_v1_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The first feature set (eight columns) from a sparse daily input."""
    today = chain(df, "hujan_hari_ini")
    lags = [chain(df, f"hujan_lag{i}") for i in (1, 2, 3)]
    return df.select(
        *keep,
        today.alias("curah_hujan_mm"),
        chain(df, "durasi_hari_ini").alias("durasi_hujan_jam"),
        chain(df, "pasut_msl_max").alias("pasut_msl_max"),
        chain(df, "pasut_slope").alias("pasut_slope"),
        *[c.alias(f"hujan_lag{i}") for i, c in enumerate(lags, 1)],
        (today + lags[0] + lags[1]).alias("hujan_3days"),
    )


def legacy_v1_hourly(hourly: DataFrame, by: str = "loc", time: str = "time", size: int = series.HOURS_PER_CHUNK) -> DataFrame:
    """The first feature set for every hour of a dense series."""
    s, _ = open_hourly(hourly, by, time, size)
    rain = F.col("precipitation")
    s.add(
        curah_hujan_mm=s.rolling(rain, 24),
        durasi_hujan_jam=s.rolling(F.when(rain.isNotNull(), flag(rain > 0)), 24, min_rows=24),
        pasut_msl_max=F.col("est"),
        pasut_slope=s.diff("est", 1),
        **{f"hujan_lag{k}": F.coalesce(s.day_total(rain, k), F.lit(0.0)) for k in (1, 2, 3)},
    )
    s.add(hujan_3days=decayed([F.col("curah_hujan_mm"), *[F.col(f"hujan_lag{k}") for k in (1, 2, 3)]], config.API_DECAY))
    names = ["curah_hujan_mm", "durasi_hujan_jam", "pasut_msl_max", "pasut_slope", "hujan_lag1", "hujan_lag2", "hujan_lag3", "hujan_3days"]
    return s.rows().select(by, time, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) if n == "durasi_hujan_jam" else F.col(n) for n in names])


# --- model boundary ----------------------------------------------------------------------------


def select_model_features(df: DataFrame, needed: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The needed features that exist, in model order with NULL as 0, and the names that are missing."""
    missing = [f for f in needed if f not in df.columns]
    present = [F.coalesce(F.col(f), F.lit(0)).alias(f) for f in needed if f in df.columns]
    return df.select(*keep, *present), missing


def align_features(df: DataFrame, needed: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """All needed features in model order; absent ones become 0."""
    return df.select(*keep, *[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in needed])


def what_if(base: DataFrame, scenarios: Sequence[Mapping[str, float | str | None]], name: str = "scenario") -> DataFrame:
    """Every base row under every scenario; a scenario value replaces the row's, None keeps it.

    Scenarios are literals, so rows are multiplied in place: no join and no shuffle.
    """
    fields = sorted({k for s in scenarios for k in s if k != name})
    grid = F.array(
        *[
            F.struct(F.lit(s[name]).alias(name), *[F.lit(s.get(f)).cast("double").alias(f"_{f}") for f in fields])
            for s in scenarios
        ]
    )
    wide = base.withColumn("_s", F.explode(grid))
    return wide.select(
        F.col(f"_s.{name}").alias(name),
        *[F.coalesce(F.col(f"_s._{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns],
        *[F.col(f"_s._{f}").alias(f) for f in fields if f not in base.columns],
    )
