"""Row windows over long series, split so that no task ever holds a whole series.

A window partitioned by location alone puts a location's whole history into one task. Here a series
is cut into chunks of ``size`` consecutive rows; each row is also copied into the neighbouring chunk
when that chunk's windows reach it (the halo). Windows then partition by (location, chunk), and the
copies are dropped at the end. Results equal those of the plain window; the extra volume is
(back + ahead) / size.

Functions over an unbounded past (run length, recursive index) need one more step: a value per chunk,
carried to later chunks through a table with one row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from hydrolake.functions import calendar
from hydrolake.functions.numeric import col, total

CHUNK = "_chunk"
INDEX = "_index"
OWN = "_own"

# Join strategy for tables with one row per chunk or bucket: the wide side is already partitioned and
# sorted by the join keys for its windows, so a merge join moves only the small side. Left to itself
# the optimizer may turn the join around and run the wide side's windows in the small side's tasks.
IN_PLACE = "merge"

HOURS_PER_CHUNK = 2016  # 84 days, a whole number of days
ROWS_PER_CHUNK = 4096


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def hour_index(df: DataFrame, time: str = "time") -> DataFrame:
    """Index of a dense hourly series: hours since 1970. One step per row, so rows are hours."""
    return df.withColumn(INDEX, calendar.hour_number(time))


def row_index(
    df: DataFrame, order: str | Sequence[str], by: str | Sequence[str] = "loc", bucket: Column | None = None
) -> DataFrame:
    """0-based row number within each series, for series whose rows are not evenly spaced.

    Rows are numbered inside (series, time bucket) and shifted by the number of rows in earlier
    buckets, so the sort of one series spreads over many tasks. ``bucket`` must grow with ``order``;
    it defaults to the month of the first order column.
    """
    by, order = _names(by), _names(order)
    if bucket is None:
        # rows without a date come first, in a bucket of their own
        bucket = F.coalesce(F.date_trunc("month", F.col(order[0])).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    df = df.withColumn("_bucket", bucket)
    keys = by + ["_bucket"]
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn(INDEX, within)
        .join(offsets.hint(IN_PLACE), keys)
        .withColumn(INDEX, (F.col(INDEX) + F.col("_offset") - 1).cast("long"))
        .drop("_bucket", "_offset")
    )


class Series:
    """An indexed series table cut into chunks; window columns are added, then ``rows()`` closes it."""

    def __init__(
        self,
        df: DataFrame,
        by: str | Sequence[str] = "loc",
        back: int = 0,
        ahead: int = 0,
        size: int | None = None,
        day: str | None = None,
    ):
        """``df`` carries INDEX (see hour_index, row_index).

        ``back``/``ahead``: how many rows the windows to come may look behind/ahead, chained windows
        added up. ``day`` names an integer day column of an hourly series; it leads the sort so that
        calendar-day range windows reuse the same order.
        """
        size = size or max(ROWS_PER_CHUNK, 4 * back, 4 * ahead)
        if size < back or size < ahead:
            raise ValueError(f"chunk of {size} rows is shorter than the reach ({back}, {ahead})")
        self.by, self.back, self.ahead, self.size, self.day = _names(by), back, ahead, size, day
        home = F.floor(F.col(INDEX) / F.lit(size)).cast("long")
        if back == 0 and ahead == 0:
            self.df = df.withColumn(CHUNK, home).withColumn(OWN, F.lit(True))
        else:
            place = F.pmod(F.col(INDEX), F.lit(size))
            targets = F.array_compact(
                F.array(
                    home,
                    F.when(place >= F.lit(size - back), home + 1),
                    F.when(place < F.lit(ahead), home - 1),
                )
            )
            self.df = df.withColumn(CHUNK, F.explode(targets)).withColumn(OWN, F.col(CHUNK) == home)

    @property
    def keys(self) -> list[str]:
        return [*self.by, CHUNK]

    @property
    def window(self) -> WindowSpec:
        order = [self.day, INDEX] if self.day else [INDEX]
        return W.partitionBy(*self.keys).orderBy(*order)

    def _reach(self, back: int, ahead: int = 0) -> None:
        if back > self.back or ahead > self.ahead:
            raise ValueError(f"window reaches ({back}, {ahead}), series was opened for ({self.back}, {self.ahead})")

    def add(self, **columns: Column) -> "Series":
        self.df = self.df.withColumns(columns)
        return self

    def rows(self) -> DataFrame:
        return self.df.where(F.col(OWN)).drop(CHUNK, OWN, INDEX)

    # --- window columns -------------------------------------------------------------------

    def rolling(self, value: str | Column, n: int, agg=F.sum, min_rows: int = 1) -> Column:
        """agg over the last n rows; NULL unless at least ``min_rows`` of them are non-null."""
        self._reach(n - 1)
        w = self.window.rowsBetween(-(n - 1), 0)
        out = agg(col(value)).over(w)
        return out if min_rows <= 1 else F.when(F.count(col(value)).over(w) >= min_rows, out)

    def count_last(self, n: int, exclude_current: bool = False, **conditions: Column) -> "Series":
        """Add, per condition, how many of the last n rows meet it (of the n rows before, if excluding).

        Counts are whole numbers, so a running count minus its value n rows back is exact, at a cost
        per row that does not grow with n.
        """
        near, far = (1, n + 1) if exclude_current else (0, n)
        self._reach(n if exclude_current else n - 1)
        w = self.window
        running = w.rowsBetween(W.unboundedPreceding, 0)
        self.add(**{f"_run_{c}": F.sum(F.when(cond, 1).otherwise(0)).over(running) for c, cond in conditions.items()})

        def at(c: str, k: int) -> Column:
            # beyond the first row of the chunk nothing has been counted yet
            return F.coalesce(F.lag(f"_run_{c}", k).over(w), F.lit(0)) if k else F.col(f"_run_{c}")

        self.add(**{c: at(c, near) - at(c, far) for c in conditions})
        self.df = self.df.drop(*[f"_run_{c}" for c in conditions])
        return self

    def stacked_sum(self, rolled: str, n: int, times: int) -> Column:
        """Sum over n*times rows from an n-row rolling sum: ``times`` lags instead of n*times adds."""
        self._reach(n * times - 1)
        parts = [F.lag(rolled, n * j).over(self.window) for j in range(1, times)]
        return F.when(
            F.coalesce(F.col(rolled), *parts).isNotNull(),
            total([F.coalesce(p, F.lit(0.0)) for p in [F.col(rolled), *parts]]),
        )

    def lag(self, value: str | Column, k: int = 1) -> Column:
        self._reach(k)
        return F.lag(col(value), k).over(self.window)

    def lead(self, value: str | Column, k: int = 1) -> Column:
        self._reach(0, k)
        return F.lead(col(value), k).over(self.window)

    def diff(self, value: str | Column, k: int = 1) -> Column:
        """x - x[k rows before], 0 where either is missing."""
        return F.coalesce(col(value) - self.lag(value, k), F.lit(0.0))

    def centered_mean(self, value: str | Column, half: int = 1) -> Column:
        self._reach(half, half)
        return F.avg(col(value)).over(self.window.rowsBetween(-half, half))

    def day_total(self, value: str | Column, days_before: int) -> Column:
        """Total of the calendar day ``days_before`` days earlier; NULL if that day has no rows.

        The frame moves once a day, so the sum is computed once per day, not once per row.
        """
        if not self.day:
            raise ValueError("open the series with day=<integer day column>")
        self._reach(24 * (days_before + 1) - 1)
        w = W.partitionBy(*self.keys).orderBy(self.day).rangeBetween(-days_before, -days_before)
        return F.sum(col(value)).over(w)

    def run_length(self, name: str, flag: Column, source: DataFrame) -> "Series":
        """Add ``name``: length of the run of set flags that ends at the row, 0 where it is not set.

        ``source`` is the indexed table the series was opened on; it gives the last unset row of
        every chunk, from which runs that began chunks ago are measured.
        """
        carry = last_unset(source, flag, self.by, self.size)
        seen = F.max(F.when(~flag, F.col(INDEX))).over(self.window.rowsBetween(W.unboundedPreceding, 0))
        self.df = (
            self.df.join(carry.hint(IN_PLACE), self.keys, "left")
            .withColumn(name, F.when(flag, F.col(INDEX) - F.coalesce(seen, F.col("_before"))).otherwise(F.lit(0)))
            .drop("_before")
        )
        return self


def last_unset(df: DataFrame, flag: Column, by: list[str], size: int) -> DataFrame:
    """Per chunk: index of the last unset row in earlier chunks (first index - 1 if there is none)."""
    chunk = F.floor(F.col(INDEX) / F.lit(size)).cast("long")
    per_chunk = (
        df.withColumn(CHUNK, chunk)
        .groupBy(*by, CHUNK)
        .agg(F.max(F.when(~flag, F.col(INDEX))).alias("_unset"), F.min(INDEX).alias("_first"))
    )
    past = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, 0)
    return per_chunk.select(
        *by,
        CHUNK,
        F.coalesce(F.max("_unset").over(past), F.min("_first").over(whole) - 1).alias("_before"),
    )


def run_length(
    df: DataFrame, flag: Column, name: str = "run", by: str | Sequence[str] = "loc", size: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Length of the current run of rows with the flag set (gaps and islands), on an indexed table.

    A NULL flag counts as not set.
    """
    flag = F.coalesce(flag, F.lit(False))
    return Series(df, by, size=size).run_length(name, flag, df).rows()


def recursive_index(
    df: DataFrame,
    value: str,
    k: float,
    name: str = "api",
    by: str | Sequence[str] = "loc",
    size: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """a[t] = x[t] + k * a[t-1] from the start of the series, on an indexed table without gaps.

    Inside a chunk, a[t] = k^t * sum(x[i] * k^-i): one running sum, no per-row loop. The chunk length
    is limited so that k^-i stays inside double range. What earlier chunks leave behind reaches a
    chunk through one value per chunk, decayed by the distance; the decay is taken in two factors, so
    it falls out of double range only where any double would. The result does not depend on ``size``.
    """
    if not 0 < k < 1:
        raise ValueError("decay must lie between 0 and 1")
    by = _names(by)
    longest = max(1, int(300 / -math.log(k)))
    size = min(max(size, 64), longest)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    place = F.pmod(F.col(INDEX), F.lit(size)).cast("double")
    base = df.withColumn(CHUNK, F.floor(F.col(INDEX) / F.lit(size)).cast("long"))

    ends = base.groupBy(*by, CHUNK).agg(F.sum(x * F.pow(F.lit(k), F.lit(size - 1) - place)).alias("_end"))
    # the whole range of doubles spans fewer than 1,500 powers of e: older chunks leave exactly nothing
    chunks_back = math.ceil(1500 / (-math.log(k) * size)) + 1
    past = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(-chunks_back, -1)
    left = F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("_end").alias("e"))).over(past)
    half = lambda s: F.pow(F.lit(k), (F.col(CHUNK) - 1 - s["c"]) * F.lit(size / 2))
    carry = ends.select(*by, CHUNK, left.alias("_left")).select(
        *by,
        CHUNK,
        F.aggregate(
            "_left",
            F.lit(0.0),
            lambda acc, s: acc + s["e"] * half(s) * half(s),
        ).alias("_carry"),
    )
    running = W.partitionBy(*by, CHUNK).orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    local = F.pow(F.lit(k), place) * F.sum(x * F.pow(F.lit(k), -place)).over(running)
    return (
        base.join(carry.hint(IN_PLACE), [*by, CHUNK], "left")
        .withColumn(name, local + F.pow(F.lit(k), place + 1) * F.coalesce(F.col("_carry"), F.lit(0.0)))
        .drop(CHUNK, "_carry", INDEX)
    )


def backfill_first(
    df: DataFrame,
    value: str,
    name: str,
    by: str | Sequence[str] = "loc",
    size: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Lag-1 of ``value``; a missing one takes the next known lagged value of the series.

    The next known value may lie many chunks ahead, so it is carried back by one row per chunk.
    """
    by = _names(by)
    s = Series(df, by, back=1, size=size).add(_lagged=F.lag(value, 1).over(
        W.partitionBy(*by, CHUNK).orderBy(INDEX)))
    own = s.df.where(F.col(OWN)).drop(OWN)
    # the first non-null lagged value at or after a chunk's start is the first non-null value
    # at or after one row earlier
    chunk = F.floor((F.col(INDEX) + 1) / F.lit(size)).cast("long")
    firsts = (
        df.where(F.col(value).isNotNull())
        .withColumn(CHUNK, chunk)
        .groupBy(*by, CHUNK)
        .agg(F.min_by(value, INDEX).alias("_head"))
    )
    chunks = own.select(*by, CHUNK).distinct()
    ahead = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(1, W.unboundedFollowing)
    # chunks holding no row of their own can only appear past the end, where nothing follows
    carry = (
        firsts.join(chunks, [*by, CHUNK], "full")
        .select(*by, CHUNK, F.first("_head", ignorenulls=True).over(ahead).alias("_next"))
    )
    rest = W.partitionBy(*by, CHUNK).orderBy(INDEX).rowsBetween(0, W.unboundedFollowing)
    return (
        own.join(carry.hint(IN_PLACE), [*by, CHUNK], "left")
        .withColumn(name, F.coalesce(F.first("_lagged", ignorenulls=True).over(rest), F.col("_next")))
        .drop(CHUNK, "_lagged", "_next", INDEX)
    )
