"""Numbers of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import stored


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition over pairs of column names; null meets null."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank", size: str = "") -> DataFrame:
    """All rows with their number (from 0) among the rows of their group in ascending order, nulls first, and the group's size.

    Rows are dealt by ranges of (group, order), so a group may span many tasks; each task's rows of a group are then
    shifted by the rows of earlier tasks (one row per task and group). The order should tell rows apart: rows equal
    in it meet in one task, and which of them comes first is left open. The rows are written once, so a number stays
    what it is when a task runs again.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first"))
    parts = parts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), "_shift", "_all")
    met = placed.join(parts, same(placed, parts, [(g, f"_{g}") for g in group] + [("_part", "_p")]))
    return met.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name), *([F.col("_all").alias(size)] if size else []))
