"""Null-aware arithmetic helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def clip(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; a NULL stays NULL (greatest/least alone would replace it by the bound)."""
    v = col(value)
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(v.isNotNull(), out)


def zero(value: str | Column) -> Column:
    """NULL or NaN to 0."""
    v = col(value)
    return F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))


def guarded_ratio(num: Column, den: Column, eps: float) -> Column:
    return num / (den + F.lit(eps))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def decayed(columns: list[Column], k: float) -> Column:
    """x0 + k*x1 + k^2*x2 + ..."""
    return total([c if i == 0 else F.lit(k**i) * c for i, c in enumerate(columns)])


def unit_hash(*parts: str | Column, seed: int = 42, salt: str = "") -> Column:
    """A number in [0, 1) fixed by the row's key, so it does not move under repartitioning."""
    return F.conv(F.substring(key_hash(*parts, seed=seed, salt=salt), 1, 8), 16, 10).cast("double") / F.lit(
        float(2**32)
    )


def key_hash(*parts: str | Column, seed: int = 42, salt: str = "") -> Column:
    """md5 of seed, salt and key as hex text; its text order is a uniform random order of the keys."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), *[col(p).cast("string") for p in parts]))


def with_ordered_code(df: DataFrame, value: str | Column, name: str) -> DataFrame:
    """Adds a double as a long of the same order: sign, exponent and mantissa, as they stand in its 64 bits.

    Equal doubles have equal codes (0 and -0 too); NULL and NaN have none. Each step is a column of its own, so that it
    is computed once a row.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    v, size, guess, exponent = (F.col(f"_{name}_{part}") for part in ("value", "size", "guess", "exponent"))
    out = df.withColumn(f"_{name}_value", col(value).cast("double")).withColumn(f"_{name}_size", F.abs(v))
    out = out.withColumn(f"_{name}_guess", F.floor(F.least(F.greatest(F.log2(size), F.lit(-1022.0)), F.lit(1023.0))).cast("int"))
    # the logarithm may be off by one next to a power of two; powers and quotients by powers are exact
    off = F.when((power(guess) > size) & (guess > -1022), -1).when((guess < 1023) & (power(guess + 1) <= size), 1).otherwise(0)
    out = out.withColumn(f"_{name}_exponent", guess + off)
    bits = (exponent + 1022).cast("long") * F.lit(2**52) + (size / power(exponent) * F.lit(float(2**52))).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(bits)
    code = F.when(v.isNotNull() & ~F.isnan(v), bits * F.when(v < 0, F.lit(-1)).otherwise(F.lit(1)))
    return out.withColumn(name, code).drop(*[f"_{name}_{part}" for part in ("value", "size", "guess", "exponent")])


def from_ordered_code(code: Column) -> Column:
    """The double of a code."""
    size = F.abs(code)
    high = F.shiftright(size, 52).cast("int")
    low = size - F.shiftleft(high.cast("long"), 52)
    normal = (low + F.lit(2**52)).cast("double") * F.pow(F.lit(2.0), high - 1075)
    # 2^-1074 is the least double; the factor in two steps keeps both of them exact
    tiny = low.cast("double") * F.pow(F.lit(2.0), F.lit(-1022)) * F.pow(F.lit(2.0), F.lit(-52))
    split = (low + F.lit(2**52)).cast("double") * F.pow(F.lit(2.0), F.lit(-52)) * F.pow(F.lit(2.0), high - 1023)
    amount = F.when(high == 2047, F.lit(float("inf"))).when(high == 0, tiny).when(high < 60, split).otherwise(normal)
    return F.when(code < 0, -amount).otherwise(amount)
