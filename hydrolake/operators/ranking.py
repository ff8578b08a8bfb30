"""Ranks, class sampling, duplicates and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions.numeric import key_hash
from hydrolake.functions.text import display_name


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str, date: str | None = None) -> DataFrame:
    """Rows and share per class, with the date range if a date column is named."""
    dates = [F.min(date).alias("first_date"), F.max(date).alias("last_date")] if date else []
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *dates)
    whole = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("ratio", F.col("n") / whole)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    whole = counts.select(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("s")).scalar()
    return counts.withColumn("weight", whole.getField("rows") / (whole.getField("classes") * F.col("n")))


def label_encode(df: DataFrame, column: str, name: str = "encoded") -> DataFrame:
    """0-based position of each value among the sorted distinct ones."""
    classes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class is numbered, and joined where it is used
    codes = classes.select("_class", (F.row_number().over(W.orderBy("_class")) - 1).cast("int").alias(name))
    return df.join(codes, F.col(column) == F.col("_class"), "left").drop("_class")


def class_rank(df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42, hex_digits: int = 3) -> DataFrame:
    """Adds ``_rank`` (1..n in hash order within the class) and ``_n`` (rows of the class).

    The order is fixed by the key, so it survives repartitioning and retries. Rows are ranked inside
    16^hex_digits hash buckets per class and shifted by the rows of lower buckets, so a class that
    holds most of the table is still spread over all tasks. ``key`` must identify a row. Rows without
    a label are a class of their own.
    """
    key = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", key_hash(*key, seed=seed)).withColumn("_slot", F.substring("_hash", 1, hex_digits))
    hashed = hashed.withColumn("_class", F.struct(F.col(label).alias("c")))  # a struct that holds NULL equals another
    per_slot = hashed.groupBy("_class", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    lower = W.partitionBy("_class").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slot.select(
        "_class",
        "_slot",
        F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_shift"),
        F.sum("_c").over(W.partitionBy("_class")).alias("_n"),
    )
    inside = F.row_number().over(W.partitionBy("_class", "_slot").orderBy("_hash"))
    return (
        hashed.withColumn("_rank", inside)
        .join(offsets.hint("merge"), ["_class", "_slot"])
        .withColumn("_rank", F.col("_rank") + F.col("_shift"))
        .drop("_class", "_slot", "_shift", "_hash")
    )


def stratified_split(df: DataFrame, label: str, key, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly round(share * n) rows of every class are 1."""
    ranked = class_rank(df, label, key, seed)
    return ranked.withColumn(
        "is_train", F.when(F.col("_rank") <= F.round(F.col("_n") * F.lit(train_share)), 1).otherwise(0)
    ).drop("_rank", "_n")


def plain_split(df: DataFrame, key, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    return stratified_split(df.withColumn("_one", F.lit(0)), "_one", key, train_share, seed).drop("_one")


def kfold_assign(df: DataFrame, label: str, key, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1; classes are spread evenly over the folds."""
    ranked = class_rank(df, label, key, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n")


def repeat_rows(df: DataFrame, copies: Column, keys: Sequence[str], name: str = "copy", block: int = 1024) -> DataFrame:
    """Each row ``copies`` times, numbered from 1; rows with none are dropped.

    A row of a rare class may be repeated without limit, so the repeats are laid out in blocks that
    are spread over the tasks before they are written out.
    """
    rows = df.withColumn("_copies", copies.cast("long")).where(F.col("_copies") > 0)
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {block}"))))
    spread = blocks.repartition(*keys, "_block")
    first = F.col("_block") * block
    numbers = F.sequence(first + 1, F.least(F.col("_copies"), first + block))
    return spread.withColumn(name, F.explode(numbers)).drop("_copies", "_block")


def upsample(df: DataFrame, label: str, key, seed: int = 42) -> DataFrame:
    """Repeat rows until every class is as large as the largest; ``copy`` numbers the repeats from 1.

    Every row is repeated equally often, up to one; the rows that get one more are those first in
    hash order.
    """
    biggest = class_counts(df, label).agg(F.max("n").alias("m")).scalar()
    ranked = class_rank(df, label, key, seed).withColumn("_m", biggest)
    copies = F.expr("_m div _n") + F.when(F.col("_rank") <= F.col("_m") % F.col("_n"), 1).otherwise(0)
    keys = [key] if isinstance(key, str) else list(key)
    return repeat_rows(ranked, copies, keys).drop("_rank", "_n", "_m")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order. A min_by aggregate folds copies before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def preview(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """n random rows, the same ones on every run."""
    return df.orderBy(key_hash(key, seed=seed)).limit(n)


def top_importance(df: DataFrame, k: int, feature: str = "feature", value: str = "importance", by: Sequence[str] = ()) -> DataFrame:
    """The k largest per group as rows and as text 'name=0.123, ...'."""
    by = list(by)
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    if not by:  # the k largest of all are found per task first
        base = base.orderBy(F.desc(value), F.asc(feature)).limit(k)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), F.asc(feature)))
    top = base.withColumn("rank", rank).where(F.col("rank") <= k)
    text = F.concat(F.col(feature), F.lit("="), F.format_string("%.3f", F.bround(value, 3)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"])
    out = top.groupBy(*keys).agg(
        F.array_join(parts, ", ").alias("top_text"), F.max(value).alias("max_importance")
    )
    return out if by else out.drop("_all")


def top_contributions(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], k: int = 10, signed: int = 5) -> DataFrame:
    """Per row its strongest contributions: rank by size, direction, and rank among its own sign.

    Kept are the k largest by absolute value and the ``signed`` largest of each sign. Contributions
    sit in one row, so they are ordered inside an array; nothing is shuffled.
    """
    items = F.array(
        *[F.struct(F.abs(F.col(f)).alias("size"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("contribution")) for f in features]
    )
    by_size = F.array_sort(
        items,
        lambda a, b: F.when(a["size"] > b["size"], -1)
        .when(a["size"] < b["size"], 1)
        .when(a["feature"] < b["feature"], -1)
        .when(a["feature"] > b["feature"], 1)
        .otherwise(0),
    )
    ranked = df.select(*id_cols, by_size.alias("_c"))
    plus = F.filter("_c", lambda s: s["contribution"] > 0)
    minus = F.filter("_c", lambda s: s["contribution"] < 0)
    ranked = ranked.withColumns({"_plus": F.transform(plus, lambda s: s["feature"]), "_minus": F.transform(minus, lambda s: s["feature"])})
    rows = ranked.select(*id_cols, "_plus", "_minus", F.posexplode("_c").alias("_pos", "_s"))
    sign_rank = F.when(F.col("_s.contribution") > 0, F.array_position("_plus", F.col("_s.feature"))).when(
        F.col("_s.contribution") < 0, F.array_position("_minus", F.col("_s.feature"))
    )
    return rows.select(
        *id_cols,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_s.feature").alias("feature"),
        display_name("_s.feature").alias("display"),
        F.col("_s.contribution").alias("contribution"),
        F.when(F.col("_s.contribution") > 0, "Increase Risk").otherwise("Decrease Risk").alias("direction"),
        sign_rank.cast("int").alias("sign_rank"),
    ).where((F.col("rank") <= k) | (F.col("sign_rank") <= signed))
