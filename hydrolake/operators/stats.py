"""Exact percentiles and the statistics built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions.numeric import col, from_ordered_code, with_ordered_code
from hydrolake.operators.keys import join_keys

#: Bits of a value's code that are still open after each round of the selection.
OPEN_BITS = (42, 20, 0)


def selected(df: DataFrame, value: str, ranks: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """by, ``n`` and ``v``, an array of the values that stand at the given ranks (from 0) of each group.

    ``ranks`` are expressions of ``n``, the group's number of values. Selection by digits: values are read as 64-bit codes
    of the same order; each round counts, per group, the values by their next 20 or 22 bits, but only where the bits settled
    so far are those of a wanted rank. After three rounds each rank has its value. Every round is one aggregate that
    folds on the map side, and no window holds more than 2^22 rows, however many the group has. One way for all sizes: groups are never sorted or
    gathered, and a group may hold any share of the rows. NULL and NaN values are left out.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = with_ordered_code(df.select(*by, col(value).alias("_value")), "_value", "_c").select(*by, "_c").where(F.col("_c").isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    wanted = F.array(*[r.cast("long") for r in ranks])
    found, settled = None, 64
    for shift in OPEN_BITS:
        prefix = F.shiftright("_c", shift)
        if found is None:
            counts = rows.groupBy(*keys, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
            counts = counts.withColumn("n", F.sum("_n").over(W.partitionBy(*keys))).withColumn("_base", F.lit(0).cast("long"))
            inside = W.partitionBy(*keys).orderBy("_p")
        else:
            near = join_keys(rows.withColumn("_u", F.shiftright("_c", settled)), found, [*keys, "_u"])
            # n and the rows below are the same for all rows of a prefix; as keys they need no second join
            counts = near.groupBy(*keys, "_u", "n", "_base", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
            inside = W.partitionBy(*keys, "_u").orderBy("_p")
        below = F.coalesce(F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_base", F.col("_base") + below)
        held = lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_n"))
        hit = reduce(lambda a, b: a | b, [held(r.cast("long")) for r in ranks])
        settled = shift
        last, found = counts.where(hit), counts.where(hit).select(*keys, "n", F.col("_base"), F.col("_p").alias("_u"))
    here = F.filter(F.transform(wanted, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda w: held(w["r"]))
    each = last.select(*keys, "n", F.explode(here).alias("_w"), from_ordered_code(F.col("_p")).alias("_v"))
    values = F.array_sort(F.collect_list(F.struct(F.col("_w.i").alias("i"), F.col("_v").alias("v"))))
    out = each.groupBy(*keys, "n").agg(F.transform(values, lambda s: s["v"]).alias("v"))
    return out if by else out.drop("_all")


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentiles per group, column ``q`` (array in the order of ``probs``), and ``n``."""
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = [r for p in probs for r in (F.floor(place(p)), F.ceil(place(p)))]
    at = selected(df, value, ranks, by)
    v = F.col("v")
    steps = [v[2 * i] + (v[2 * i + 1] - v[2 * i]) * (place(p) - F.floor(place(p))) for i, p in enumerate(probs)]
    # between equal values, infinite ones too, nothing is to be interpolated
    q = [F.when(v[2 * i] == v[2 * i + 1], v[2 * i]).otherwise(s) for i, s in enumerate(steps)]
    return at.select(*by, "n", F.array(*q).alias("q"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, median, sample standard deviation and range of each column, one row each."""
    by = list(by)
    long = df.unpivot(by, list(columns), "measure", "value")
    basic = long.groupBy(*by, "measure").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (F.max("value") - F.min("value")).alias("range"),
    )
    median = exact_percentiles(long, "value", [0.5], [*by, "measure"]).select(
        *by, "measure", F.col("q")[0].alias("median")
    )
    return join_keys(basic, median, [*by, "measure"], "left")


QUARTILE_NAMES = ["Sangat Rendah", "Rendah", "Tinggi", "Sangat Tinggi"]


def quartile_bins(df: DataFrame, value: str, by: Sequence[str], name: str = "kategori") -> DataFrame:
    """Rows with their quartile class, lower classes closed on the right; NULL for a missing value."""
    edges = exact_percentiles(df, value, [0.25, 0.5, 0.75], by).select(*by, F.col("q").alias("_q"))
    chain = F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")), F.lit(None)).when(F.col(value) <= F.col("_q")[0], QUARTILE_NAMES[0])
    for i in (1, 2):
        chain = chain.when(F.col(value) <= F.col("_q")[i], QUARTILE_NAMES[i])
    return join_keys(df, edges, list(by), "left").withColumn(name, chain.otherwise(QUARTILE_NAMES[3])).drop("_q")


def bin_shares(binned: DataFrame, by: Sequence[str], name: str = "kategori") -> DataFrame:
    counts = binned.groupBy(*by, name).agg(F.count(F.lit(1)).alias("jumlah"))
    share = F.lit(100.0) * F.col("jumlah") / F.sum("jumlah").over(W.partitionBy(*by))
    return counts.withColumn("persen", share)


def iqr_bounds(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    q = exact_percentiles(df, value, [0.25, 0.75], by)
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select(*by, (F.col("q")[0] - 1.5 * spread).alias("lower"), (F.col("q")[1] + 1.5 * spread).alias("upper"))


def iqr_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges, with the bounds; rows without a group key are a group of their own."""
    return join_keys(df, iqr_bounds(df, value, by), list(by)).where(
        (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    )


def series_completeness(df: DataFrame, time: str, by: str, step_seconds: int = 600) -> DataFrame:
    """Per series: steps expected between first and last, steps present, missing, duplicate rows."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(micros / (step_seconds * 1_000_000)).cast("long")
    # one row per (series, step) first: repeated readings fold before the shuffle
    slots = df.groupBy(by, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    return slots.groupBy(by).agg(
        (F.max("_slot") - F.min("_slot") + 1).alias("expected"),
        F.count(F.lit(1)).alias("present"),
        F.sum("_rows").alias("n_rows"),
    ).select(
        by,
        "expected",
        "present",
        "n_rows",
        (F.col("expected") - F.col("present")).alias("missing"),
        (F.col("n_rows") - F.col("present")).alias("duplicates"),
    )


def mean_impute(train: DataFrame, columns: Sequence[str], other: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the training mean; the means are scalar subqueries, so nothing is collected."""
    target = other if other is not None else train
    means = train.select(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return target.withColumns({c: F.coalesce(F.col(c).cast("double"), means.getField(c)) for c in columns})


def standardize(train: DataFrame, columns: Sequence[str], other: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a constant column becomes 0."""
    target = other if other is not None else train
    stats = train.select(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
        ).alias("s")
    ).scalar()

    def scaled(c: str) -> Column:
        sd = stats.getField(f"{c}_s")
        return (F.col(c) - stats.getField(f"{c}_m")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return target.withColumns({c: scaled(c) for c in columns})
