"""Where queries register themselves together with their oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.catalog.ctes import NUDGE, r, with_relations
from hydrolake.session import apply_runtime

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None
    digits: int

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return presentable(self.build(apply_runtime(spark), sf_dir), self.digits)


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None, name: str | None = None, digits: int = 6):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(build: Build) -> Build:
        key = name or build.__name__
        if key in REGISTRY:
            raise ValueError(f"{key} registered twice")
        REGISTRY[key] = Query(key, build, oracle, digits)
        return build

    return add


def presentable(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, dates and times as text: the form in which two engines can be compared."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits).alias(field.name)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string").alias(field.name)
        out.append(c)
    return df.select(*out)


def oracle(columns: str, body: str, relations: str = "", extra: dict[str, str] | None = None, digits: int = 6) -> str:
    """Oracle text. ``columns``: names, marked :d (double, rounded), :t (date/time), :i (integer)."""
    picks = []
    for token in columns.split():
        name, _, kind = token.partition(":")
        q = f'"{name}"'
        picks.append(
            {"d": f"{r(q, digits)} as {q}", "t": f"{q}::varchar as {q}", "i": f"{q}::bigint as {q}", "": q}[kind]
        )
    return with_relations(relations.split(), f"select {', '.join(picks)} from ({body})", extra) if relations or extra else (
        f"select {', '.join(picks)} from ({body})"
    )
