from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hydrolake.llm import mixing

from .conftest import words_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    queries = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries and set(entry.oracle_sql()) <= set(queries)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_each_stage_on_its_predecessors_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == COLUMNS
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] >= sizes[2] >= sizes[3] > 0
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count()


def test_language_stage_drops_texts_without_letters(spark, awkward):
    docs = awkward.select(*COLUMNS)
    kept = corpus_pipeline.identify(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_mixing_stage_repeats_and_cuts(spark, awkward):
    docs = awkward.select(*COLUMNS)
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert got[0].asDict().keys() == set(COLUMNS)
    words = Counter()
    for r in got:
        words[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert words == +want


def test_repeated_rows_get_their_own_turns(spark):
    """50 copies of a row and rows of equal id, source and size but other text: every word that the mix takes, no more."""
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 50 + [(1, "t u v w x y z", "en", "s", 13), (None, "h i", None, None, 3), (None, "j k", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    for source in ("s", None):
        assert sum(len(r["text"].split()) for r in got if r["source"] == source) == round(target[source])
    assert all(any(own.startswith(r["text"]) for _, own, *_ in rows) for r in got)


@pytest.mark.parametrize("rows", ["awkward", "nothing"])
def test_the_whole_pipeline_on_odd_tables(spark, tmp_path, request, rows):
    df = request.getfixturevalue(rows)
    df.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    n = out.count()
    assert n > 0 if rows == "awkward" else n == 0
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
