"""Ready-made series operators: each takes an indexed table and adds columns.

``df`` carries the index column of ``series.hour_index`` (dense hourly rows) or
``series.row_index`` (rows as they come).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk
from hydrolake.functions.numeric import decayed, flag
from hydrolake.operators.series import Series, recursive_index, run_length

By = str | Sequence[str]


def rolling(df: DataFrame, column: str, n: int, agg=F.sum, name: str | None = None, min_rows: int = 1, by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=n - 1, size=size)
    return s.add(**{name or f"{column}_{n}": s.rolling(column, n, agg, min_rows)}).rows()


def rolling_rain(df: DataFrame, rain: str = "precipitation", by: By = "loc", size: int | None = None) -> DataFrame:
    """3, 24, 72 and 168-row rain totals from one shuffle; the long ones are stacked from 24 rows."""
    s = Series(df, by, back=167, size=size)
    s.add(rain_3h=s.rolling(rain, 3), rain_24h=s.rolling(rain, 24))
    return s.add(rain_72h=s.stacked_sum("rain_24h", 24, 3), rain_168h=s.stacked_sum("rain_24h", 24, 7)).rows()


def burst_count(df: DataFrame, rain: str = "precipitation", n: int = 24, by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=n - 1, size=size)
    return s.count_last(n, rain_burst_count=F.col(rain) > config.RAIN_BURST).rows()


def rain_duration(df: DataFrame, rain: str = "precipitation", n: int = 24, by: By = "loc", size: int | None = None) -> DataFrame:
    """Wet hours among the last n; NULL until n rows exist."""
    s = Series(df, by, back=n - 1, size=size)
    wet = F.when(F.col(rain).isNotNull(), flag(F.col(rain) > 0))
    return s.add(durasi_hujan_jam=s.rolling(wet, n, min_rows=n)).rows()


def rain_acceleration(df: DataFrame, rain: str = "precipitation", n: int = 3, by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=n, size=size)
    s.add(_smooth=s.rolling(rain, n, F.avg))
    return s.add(rainfall_acceleration=s.diff("_smooth", 1)).rows().drop("_smooth")


def diff(df: DataFrame, column: str, k: int, name: str, by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=k, size=size)
    return s.add(**{name: s.diff(column, k)}).rows()


def row_lags(df: DataFrame, column: str, ks: Sequence[int], prefix: str, by: By = "loc", size: int | None = None) -> DataFrame:
    """Values k rows earlier, 0 where there is none (row shift; see calendar_lags for dates)."""
    s = Series(df, by, back=max(ks), size=size)
    return s.add(**{f"{prefix}{k}": F.coalesce(s.lag(column, k), F.lit(0.0)) for k in ks}).rows()


def daily_cumsum(df: DataFrame, column: str = "rain_sum_imputed", ns: Sequence[int] = (3, 7), by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=max(ns) - 1, size=size)
    return s.add(**{f"rain_cumsum_{n}d": s.rolling(column, n) for n in ns}).rows()


def flood_history(df: DataFrame, n: int = 30, exclude_current: bool = True, label: str = "label", by: By = "loc", size: int | None = None) -> DataFrame:
    """Flood (label 2) and overflow-or-worse (label >= 1) events in the last n rows.

    ``exclude_current=False`` counts the row's own label too, which leaks the target.
    """
    s = Series(df, by, back=n, size=size)
    return add_flood_history(s, n, exclude_current, label).rows()


def add_flood_history(s: Series, n: int = 30, exclude_current: bool = True, label: str = "label") -> Series:
    return s.count_last(n, exclude_current, prev_flood_30d=F.col(label) == 2, prev_meluap_30d=F.col(label) >= 1)


def rain_streaks(df: DataFrame, rain: str, name: str, by: By = "loc", size: int = 4096) -> DataFrame:
    return run_length(df, F.col(rain) > 0, name, by, size)


def centered_mean(df: DataFrame, column: str, half: int = 1, name: str | None = None, by: By = "loc", size: int | None = None) -> DataFrame:
    s = Series(df, by, back=half, ahead=half, size=size)
    return s.add(**{name or column: s.centered_mean(column, half)}).rows()


def tide_trend(df: DataFrame, tide: str = "est", eps: float = 0.05, by: By = "loc", size: int | None = None) -> DataFrame:
    """Change from the previous row; the first row of a series looks at the next one instead."""
    s = Series(df, by, back=1, ahead=1, size=size)
    s.add(
        tide_change=F.coalesce(
            F.col(tide) - s.lag(tide, 1),
            F.col(tide) - s.lead(tide, 1),
            F.lit(0.0),
        )
    )
    return s.add(tide_trend=risk.tide_trend_class(F.col("tide_change"), eps)).rows()


def api_recursive(df: DataFrame, rain: str, k: float = config.API_DECAY, name: str = "api", by: By = "loc", size: int = 4096) -> DataFrame:
    return recursive_index(df, rain, k, name, by, size)


def api_lags(columns: list[Column], k: float = config.API_DECAY) -> Column:
    """Finite index: today first, then the lags."""
    return decayed(columns, k)
