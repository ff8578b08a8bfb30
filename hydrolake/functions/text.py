"""Text rendering: fixed decimals, Indonesian dates, display names, alert messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions.numeric import col, total

# Halves between tenths whose nearest double rounds up to the next tenth when
# rounding is done on the exact binary value with ties to even.
_HALF_ROUNDS_UP = {0.05, 0.45, 0.55, 0.65, 0.75}


def fixed1(value: str | Column) -> Column:
    """One decimal, rounding the exact binary value (0.25 -> '0.2', 0.35 -> '0.3').

    ``format_string('%.1f')`` rounds the shortest decimal text half up and differs on such ties.
    """
    v = col(value).cast("double")
    whole = F.floor(F.abs(v)).cast("double")
    rest = F.abs(v) - whole
    tenths = total(
        [
            F.when(rest >= h if h in _HALF_ROUNDS_UP else rest > h, 1).otherwise(0)
            for h in [(2 * i + 1) / 20 for i in range(10)]
        ]
    )
    text = F.format_string("%.1f", whole + tenths / F.lit(10.0))
    return F.when(v.isNotNull(), F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), text))


def fixed0(value: str | Column) -> Column:
    """No decimals, ties to even."""
    return F.format_string("%.0f", F.bround(col(value).cast("double"), 0))


def _nth(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def format_id_date(day: str | Column) -> Column:
    """'Senin, 08 Des'."""
    d = col(day)
    return F.concat(
        _nth(config.ID_DAYS, F.weekday(d) + 1),
        F.lit(", "),
        F.lpad(F.dayofmonth(d).cast("string"), 2, "0"),
        F.lit(" "),
        _nth(config.ID_MONTHS, F.month(d)),
    )


def display_name(feature: str | Column) -> Column:
    """'rain_cumsum_3d' -> 'Rain Cumsum 3D': a letter after a digit also starts a word."""
    spaced = F.translate(col(feature), "_", " ")
    split = F.regexp_replace(spaced, "([0-9])(?=[a-z])", "$1| ")
    return F.replace(F.initcap(split), F.lit("| "), F.lit(""))


def or_default(text: str | Column, default: str) -> Column:
    return F.coalesce(F.nullif(col(text), F.lit("")), F.lit(default))


def alert_icon(status: str | Column) -> Column:
    out = F.lit(config.ALERT_ICON_OTHER)
    for name, icon in config.ALERT_ICON.items():
        out = F.when(col(status) == name, F.lit(icon)).otherwise(out)
    return out


def alert_message(location, status, depth_cm, reasoning, recommendation, at, source=config.ALERT_SOURCE) -> Column:
    """The alert text; ``at`` is the issue time, given by the caller so that reruns agree."""
    rule = F.lit("━━━━━━━━━━━━━━━━━━━━")
    lines = [
        F.concat(alert_icon(status), F.lit(" *PERINGATAN BANJIR - "), col(status), F.lit("*")),
        rule,
        F.lit(""),
        F.concat(F.lit("📍 *Lokasi:* "), col(location)),
        F.concat(F.lit("🌊 *Kedalaman:* "), fixed0(depth_cm), F.lit(" cm")),
        F.concat(F.lit("⏰ *Waktu:* "), F.date_format(col(at), "dd/MM/yyyy HH:mm"), F.lit(" WITA")),
        F.lit(""),
        F.lit("📋 *Penyebab:*"),
        or_default(reasoning, config.ALERT_DEFAULT_REASON),
        F.lit(""),
        F.lit("🎯 *Rekomendasi:*"),
        or_default(recommendation, config.ALERT_DEFAULT_ADVICE),
        F.lit(""),
        rule,
        F.lit(f"_Sumber: {source}_"),
    ]
    return F.concat_ws("\n", *lines)
