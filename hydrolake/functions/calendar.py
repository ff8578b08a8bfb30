"""Calendar and clock columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions.numeric import col, flag


def day_number(ts: str | Column) -> Column:
    return F.unix_date(F.to_date(col(ts))).cast("long")


def hour_number(ts: str | Column) -> Column:
    """Hours since 1970-01-01 00:00 of a zone-less timestamp: the dense index of an hourly series."""
    return day_number(ts) * 24 + F.hour(col(ts))


def month_sin(ts: str | Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.month(col(ts)) / F.lit(12))


def month_cos(ts: str | Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.month(col(ts)) / F.lit(12))


def is_rainy_season(ts: str | Column, months=config.RAINY_MONTHS) -> Column:
    return flag(F.month(col(ts)).isin(*months))


def is_weekend(ts: str | Column) -> Column:
    return flag(F.weekday(col(ts)) >= 5)


def is_night(ts: str | Column) -> Column:
    return flag((F.hour(col(ts)) >= 22) | (F.hour(col(ts)) <= 6))


def night_factor(ts: str | Column) -> Column:
    return F.lit(1.0) + is_night(ts) * F.lit(0.2)


def local_time(utc: str | Column, zone: str = config.LOCAL_ZONE) -> Column:
    """UTC wall time to local wall time, both without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(utc))


def calendar_columns(ts: str | Column, months=config.RAINY_MONTHS) -> dict[str, Column]:
    return {
        "month": F.month(col(ts)),
        "month_sin": month_sin(ts),
        "month_cos": month_cos(ts),
        "is_rainy_season": is_rainy_season(ts, months),
        "day_of_week": F.weekday(col(ts)),
        "is_weekend": is_weekend(ts),
    }
