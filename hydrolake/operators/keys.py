"""Joins on group keys that may be NULL: a NULL group is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys under the names that key_match compares with."""
    return df.withColumnsRenamed({c: f"_k_{c}" for c in keys})


def key_match(keys: Sequence[str]) -> Column | list:
    """Condition for a join with ``same_key``; NULL meets NULL."""
    out = F.lit(True)
    for k, c in enumerate(keys):
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = one if k == 0 else out & one
    return out


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(same_key(right, keys), key_match(keys), how).drop(*[f"_k_{c}" for c in keys])
