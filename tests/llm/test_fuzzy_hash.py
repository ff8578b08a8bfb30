import hashlib

import numpy as np
from pyspark.sql import functions as F

from hydrolake.llm import fuzzy_hash

SF = "/root/testdata/sf0.01"


def edited(texts, k):
    text, after = texts[k], texts[(k + 1) % len(texts)]
    n = len(text) // 4
    return text[: len(text) - n] + after[:n], after


def check(df, rows):
    """rows: (doc_id, text) without equal ids, in order."""
    got = {r["doc_id"]: r for r in fuzzy_hash.fingerprint_edits(df).collect()}
    texts = [t or "" for _, t in rows]
    assert len(got) == len(rows)
    for k, (doc, _) in enumerate(rows):
        changed, after = edited(texts, k)
        r = got[doc]
        assert r["n_chars"] == len(texts[k]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fuzzy_hash.fingerprint(texts[k]) and r["edited_fingerprint"] == fuzzy_hash.fingerprint(changed)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if fuzzy_hash.fingerprint(after) == r["fingerprint"]:
            assert r["near_next"] == 1
    return got


def test_a_table_and_what_is_near(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    got = check(docs.repartition(4), rows)
    near = np.array([(r["near_edited"], r["near_next"]) for r in got.values() if r["n_chars"] > 200])
    assert near[:, 0].mean() > 0.6 and near[:, 1].mean() < 0.1


def test_awkward_rows(awkward, awkward_rows, nothing):
    rows = sorted({(a, b) for a, b, *_ in awkward_rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    check(awkward.dropDuplicates(["doc_id"]), rows)
    assert fuzzy_hash.fingerprint_edits(awkward).count() == len(awkward_rows)
    assert fuzzy_hash.fingerprint_edits(nothing).count() == 0


def test_one_document_is_its_own_next(spark):
    check(spark.createDataFrame([(3, "abcdefgh ijkl")], "doc_id long, text string"), [(3, "abcdefgh ijkl")])


def test_odd_texts_have_bounded_fingerprints():
    assert fuzzy_hash.fingerprint("") == "4::"
    for text in ("a" * 100_000, "ab" * 5_000, "é", "x", "\0" * 50, "word " * 3_000):
        size, one, two = fuzzy_hash.fingerprint(text).split(":")
        assert int(size) >= 4 and 1 <= len(one) <= fuzzy_hash.MOST and 1 <= len(two) <= fuzzy_hash.MOST


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_likeness_by_hand(spark):
    pairs = [("8:abcdefghij:abc", "8:abcdefghxx:abd"), ("8:abc:abcdefg", "16:abcdefgh:q"), ("16:abcdefgh:q", "8:abc:abcdefg"), ("8:abc:d", "32:abc:d"), ("4::", "4:a:b"), ("4::", "4::"), ("8:abcdefgh:x", "8:hgfedcba:x")]

    def near(x, y):
        run = min(7, len(x), len(y))
        shared = len(x) == len(y) if run == 0 else any(x[i : i + run] in y for i in range(len(x) - run + 1))
        return 1 - _distance(x, y) / max(len(x), len(y), 1) if shared else 0.0

    def want(a, b):
        (ka, a1, a2), (kb, b1, b2) = ((int(k), x, y) for k, x, y in (s.split(":") for s in (a, b)))
        if a == b:
            return 1.0
        if ka == kb:
            return max(near(a1, b1), near(a2, b2))
        return near(a1, b2) if ka == 2 * kb else near(a2, b1) if 2 * ka == kb else 0.0

    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", fuzzy_hash.likeness(F.col("a"), F.col("b")))
    for r in df.collect():
        assert abs(r["x"] - want(r["a"], r["b"])) < 1e-12


def test_rows_of_one_id_are_spread_and_chained(spark, monkeypatch):
    texts = [f"row number {i} " * 30 for i in range(400)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, "after all of them")], "doc_id long, text string").repartition(4)
    seen, stored = [], fuzzy_hash.stored
    monkeypatch.setattr(fuzzy_hash, "stored", lambda d: seen.append(stored(d)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fuzzy_hash.fingerprint_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_task = [r["count"] for r in seen[0].groupBy("task").count().collect()]
    assert len(per_task) >= 3 and max(per_task) < 250
    # every row is edited by the head of exactly one other row, all in one ring
    cut = {hashlib.sha256((t[: len(t) - len(t) // 4] + a[: len(t) // 4]).encode()).hexdigest(): (t, a) for t in [*texts, "after all of them"] for a in [*texts, "after all of them"] if a != t}
    edges = [cut[r["edited_sha256"]] for r in got if r["n_chars"] != len("after all of them")]
    assert len(got) == 401 and len({t for t, _ in edges}) == 400
