import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from hydrolake.llm import exact_dedup

from .conftest import DOCUMENTS


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r)
    out = []
    for text, members in groups.items():
        members.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], members[0][0], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, r in enumerate(members)]
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=repr)


def test_groups_of_awkward_rows(awkward, awkward_rows):
    assert found(exact_dedup.grouped(awkward)) == brute(awkward_rows)


def test_many_rounds_odd_ends_and_texts_that_share_blocks(spark):
    texts = ["abcabcabc" * n for n in range(12)] + ["abc" * 33, "abcabcabc" * 11, "ab", "abc\n", " a b c ", "abd", "x" * 64, "x" * 65, "x" * 128, "x" * 64 + "y", "𝔘𝔫𝔦" * 9, "𝔘𝔫𝔦 " * 9]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert found(exact_dedup.grouped(docs, block=4)) == brute(rows)


def test_blocks_that_share_a_hash_keep_apart(spark, awkward_rows):
    rows = [r for r in awkward_rows if len(r[1] or "") < 2000]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    weak = exact_dedup.identified(docs, block=8, code=lambda c: F.pmod(F.xxhash64(c), F.lit(5)))
    got = defaultdict(set)
    for r in weak.collect():
        got[r["rounds"], r["name"]].add(r["text_sha256"])
    want = {hashlib.sha256(plain(r[1]).encode()).hexdigest() for r in rows}
    assert all(len(s) == 1 for s in got.values()) and {next(iter(s)) for s in got.values()} == want and len(got) == len(want)


def test_no_python_runs_on_the_main_path(awkward):
    plan = exact_dedup.grouped(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


def test_a_text_of_many_copies_and_an_empty_table(spark, nothing):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("copy "), 50)).otherwise(F.concat(F.lit("own"), "id")).alias("text"))
    got = exact_dedup.grouped(docs, block=16).where("group_size > 1").agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (2000, 2000, 1, 1)
    assert exact_dedup.grouped(nothing).count() == 0
