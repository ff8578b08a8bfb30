"""Corpus pipeline: five stages that each take (spark, docs, sf_dir) and hand on what they keep.

Every stage but the last returns the columns of documents. Each works on all rows it is given and makes its own
statistics from them. Empty input gives an empty result of the same columns; extra columns are passed on up to the
mixing stage, and dropped by the last; what each operator does with nulls, empty texts and ties stands in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import importance, language_id, mixing, near_duplicates, packing
from hydrolake.llm.common import fold, prepared, stored
from hydrolake.llm.queries import vocabulary


def same_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts that are null or without letters. The language column stays as it was."""
    prepared(spark)
    model = language_id.learn(docs.where(fold("doc_id") != 0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = language_id.identify(rows, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select("row.*") if model.languages else docs


def sample_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: importance resampling towards documents labelled good."""
    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))
    return importance.resample(rows, labels).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one of the smallest id."""
    prepared(spark)
    return same_columns(near_duplicates.deduplicated(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document appears as often as the mix takes it whole, and once more cut to the words of a last, partial turn.

    Documents that the mix does not take, and those without words, go. Rows are numbered, so each of several equal rows
    gets its own turns.
    """
    prepared(spark)
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("_number")))
    taken = mixing.mix(rows.select("row.doc_id", "row.source", "row.text", "_number"), carry=("_number",)).where("taken > 0")
    met = rows.join(taken.select("_number", "size", "taken"), "_number")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    lengths = F.filter(F.concat(F.array_repeat(F.col("size"), whole), F.array(rest.cast("long"))), lambda n: n > 0)
    cut = met.withColumn("_words", F.explode(lengths))
    words = F.filter(F.split("row.text", r"[ \t-\r]+"), lambda w: w != "")
    text = F.when(F.col("_words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("_words").cast("int")), " "))
    fields = {"text": text}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: token pieces with their sequence and place."""
    prepared(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language ID", identify),
    ("quality classifier", sample_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: Language ID, importance sampling and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
