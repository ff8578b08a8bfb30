"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import stored


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node with an edge. edges: a, b, longs.

    Rounds are about logarithmic in the longest path; each writes its edges to the shared folder. A node with very many
    edges only meets their minimum, which is pre-aggregated, in a join that Spark may split.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(down.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        print_ = _print(now)
        if print_ == seen:
            break
        seen = print_
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
