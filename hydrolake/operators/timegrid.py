"""Time axes, gap filling, calendar lags, time-shifted and nearest-in-time lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import calendar
from hydrolake.functions.numeric import col


def hour_axis(spark: SparkSession, start: str, end: str, step: str = "1 hour") -> DataFrame:
    """Left-closed axis: start, start+step, ... < end."""
    return spark.range(1).select(
        F.explode(
            F.expr(
                f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval {step}, interval {step})"
            )
        ).alias("time")
    )


def axis_of(bounds: DataFrame, start: str = "start", end: str = "end", step: str = "1 hour", name: str = "time") -> DataFrame:
    """One row per step from start to end, both included, for every row of ``bounds``."""
    return bounds.withColumn(name, F.explode(F.expr(f"sequence({start}, {end}, interval {step})"))).drop(start, end)


def grid(
    keys: DataFrame, start: Column, end: Column, step: str = "1 hour", time: str = "time", span: str = "90 days"
) -> DataFrame:
    """Every step from start to end for each row of ``keys``.

    The steps are laid out in two rounds: first one row per span, spread over the tasks, then the
    steps inside it. A long series is thus built by many tasks, and only span rows are shuffled.
    """
    by = keys.columns
    spans = axis_of(keys.withColumns({"_start": start, "_end": end}).select(*by, "_end", F.col("_start").alias("start"), F.col("_end").alias("end")), step=span, name="_from")
    spread = spans.repartition(*by, "_from")
    last = F.least(F.col("_end"), F.expr(f"_from + interval {span} - interval {step}"))
    bounds = spread.withColumn("end", last).withColumnRenamed("_from", "start").drop("_end")
    return axis_of(bounds, step=step, name=time)


def gap_fill(
    df: DataFrame,
    defaults: Mapping[str, float],
    by: str = "loc",
    time: str = "time",
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Dense grid per series with defaults for the missing steps and values.

    ``df`` has at most one row per (series, step). ``start``/``end`` default to the first and last
    time of all series, read as scalar subqueries.
    """
    span = df.select(F.struct(F.min(time).alias("a"), F.max(time).alias("b")).alias("span"))
    start = start if start is not None else span.scalar().getField("a")
    end = end if end is not None else span.scalar().getField("b")
    dense = grid(df.select(by).distinct(), start, end, step, time)
    return dense.join(df, [by, time], "left").select(
        by,
        time,
        *[
            F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
            for c in df.columns
            if c not in (by, time)
        ],
    )


def fallback_series(locs: DataFrame, now: Column, defaults: Mapping[str, float], back: str = "3 days", ahead: str = "14 days") -> DataFrame:
    """Constant hourly series around ``now`` for every location: the stand-in while a feed is down."""
    bounds = locs.select(
        "*", (now - F.expr(f"interval {back}")).alias("start"), (now + F.expr(f"interval {ahead}")).alias("end")
    )
    return axis_of(bounds).withColumns({c: F.lit(float(v)) for c, v in defaults.items()}).withColumns(
        {"rain_rolling_24h": F.lit(0.0), "rain_rolling_3h": F.lit(0.0), "wind_speed_max_24h": F.lit(float(defaults["wind_speed"]))}
    )


def shift_time(df: DataFrame, hours: int, time: str = "time") -> DataFrame:
    """Move every row ``hours`` ahead: rain upstream now is water here later."""
    return df.withColumn(time, F.expr(f"{time} + interval {hours} hours"))


def calendar_lags(daily: DataFrame, value: str, n: int = 7, prefix: str = "rain_lag", by: str = "loc", date: str = "tanggal", months: int = 12) -> DataFrame:
    """Value on date-1 .. date-n, 0 where that date has no row. ``daily`` has one row per date.

    Long series are cut by calendar span; the last n days of a span are copied into the next one.
    """
    day = calendar.day_number(date)
    span = months * 31
    home = F.floor(F.col("_day") / span).cast("long")
    cut = (
        daily.withColumn("_day", day)
        .withColumn(
            "_span",
            F.explode(F.array_compact(F.array(home, F.when(F.pmod(F.col("_day"), F.lit(span)) >= span - n, home + 1)))),
        )
        .withColumn("_own", F.col("_span") == home)
    )
    w = W.partitionBy(by, "_span").orderBy("_day")
    lags = {
        f"{prefix}{k}": F.coalesce(F.sum(value).over(w.rangeBetween(-k, -k)), F.lit(0.0)) for k in range(1, n + 1)
    }
    return cut.withColumns(lags).where("_own").drop("_day", "_span", "_own")


def nearest_row(df: DataFrame, as_of: Column, by: str = "loc", time: str = "time") -> DataFrame:
    """Per series the row closest to ``as_of``; of two equally close the earlier one.

    A min_by aggregate combines on the map side; nothing is sorted and no group is collected.
    """
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(as_of.cast("timestamp")))
    best = F.min_by(F.struct(*[c for c in df.columns if c != by]), F.struct(gap, F.col(time)))
    return df.groupBy(by).agg(best.alias("_row")).select(by, "_row.*")


def latest_before(
    df: DataFrame, as_of: Column, limit: str, by: str | Sequence[str] = "loc", time: str = "time"
) -> DataFrame:
    """Per series the newest row at or before ``as_of`` and not older than ``limit``.

    Of rows of one time the one that sorts last by its other columns is taken.
    """
    by = [by] if isinstance(by, str) else list(by)
    fresh = df.where((F.col(time) <= as_of) & (F.col(time) >= as_of - F.expr(f"interval {limit}")))
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(time, *rest))
    return fresh.groupBy(*by).agg(best.alias("_row")).select(*by, "_row.*")


def upstream_recent(
    df: DataFrame, as_of: Column, rows: int = 6, rain: str = "precipitation", by: str = "loc", time: str = "time"
) -> DataFrame:
    """Rain of the last ``rows`` hours at ``as_of``, and at the end of the series (``tail``).

    Each total needs only its own few rows, so the time filter does the work of the window.
    The total is NULL unless all hours are there.
    """
    last = df.select(F.max(time).alias("t")).scalar()

    def recent(at: Column) -> Column:
        inside = (F.col(time) <= at) & (F.col(time) > at - F.expr(f"interval {rows} hours"))
        amount = F.when(inside, F.col(rain))
        return F.when(F.count(amount) == rows, F.sum(amount))

    window = F.expr(f"interval {rows} hours")
    needed = df.where(
        ((F.col(time) <= as_of) & (F.col(time) > as_of - window)) | (F.col(time) > last - window)
    )
    return needed.groupBy(by).agg(recent(as_of).alias(f"rain_recent_{rows}h"), recent(last).alias(f"tail_{rows}h")).withColumn(time, as_of)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    limit_seconds: int,
    by: str = "loc",
    left_time: str = "time",
    right_time: str = "time",
    direction: str = "backward",
    tie: str | None = None,
    prefix: str = "r_",
    bin_seconds: int | None = None,
) -> DataFrame:
    """For each left row the nearest right row before (or after) it within ``limit_seconds``.

    Both sides are laid on one time line, cut into bins. A window inside (key, bin) finds the newest
    right row of the same bin; the newest one of earlier bins comes from a table with one row per
    (key, bin). No pairs are formed, and a busy key spreads over its bins. Left columns are kept,
    right columns get ``prefix``; left rows without a match keep NULLs. Right rows of equal time are
    taken in the order of ``tie`` (the last one backward, the first one forward).
    """
    sign = 1 if direction == "backward" else -1
    width = (bin_seconds or max(60, limit_seconds // 24)) * 1_000_000

    def on_line(df: DataFrame, time: str) -> DataFrame:
        # forward lookups run on the negated axis, so both directions look back
        t = F.unix_micros(F.col(time).cast("timestamp")) * sign
        return df.withColumns({"_t": t, "_bin": F.floor(t / width).cast("long")})

    right_cols = [c for c in right.columns if c != by]
    tie_value = F.col(tie) * sign if tie else F.lit(0)
    r = on_line(right, right_time).select(
        by, "_bin", "_t", F.lit(0).alias("_side"), tie_value.alias("_tie"),
        F.struct(F.col("_t").alias("_at"), *[F.col(c).alias(f"{prefix}{c}") for c in right_cols]).alias("_r"),
    )
    l = on_line(left, left_time).select(
        by, "_bin", "_t", F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c != by]).alias("_l")
    )
    newest = r.groupBy(by, "_bin").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_end"))
    bins = l.select(by, "_bin").distinct()
    earlier = W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carry = bins.join(newest, [by, "_bin"], "full").select(
        by, "_bin", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")
    )
    line = l.unionByName(r, allowMissingColumns=True).join(carry.hint("merge"), [by, "_bin"], "left")
    inside = W.partitionBy(by, "_bin").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = line.withColumn(
        "_m", F.coalesce(F.last("_r", ignorenulls=True).over(inside), F.col("_carry"))
    ).where(F.col("_l").isNotNull())
    near = F.col("_t") - F.col("_m._at") <= limit_seconds * 1_000_000
    return found.select(
        by, "_l.*", *[F.when(near, F.col(f"_m.{prefix}{c}")).alias(f"{prefix}{c}") for c in right_cols]
    )
