import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hydrolake.llm import merkle

from .conftest import DOCUMENTS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=...):
    doc_id, own, lang, source, n_chars = row
    fields = [doc_id, source, lang, n_chars, own if text is ... else text]
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def runs(nodes):
    return [nodes[i : i + 3] for i in range(0, len(nodes), 3)]


def climb(nodes):
    """Levels of a tree from the leaves to the one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*r) for r in runs(levels[-1])])
    return levels


def proof(levels, j):
    """(before, after) of each level below the root."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[j // 3 * 3 : j // 3 * 3 + 3]
        out.append(("".join(run[: j % 3]), "".join(run[j % 3 + 1 :])))
        j //= 3
    return out


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, climb([leaf(r) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for j, r in enumerate(own):
            path = proof(levels, j) + proof(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf(r, r[1].replace("\n", "")) if changed else leaf(r)
            for before, after in path:
                h = H(before, h, after)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], H(*[b + a for b, a in path]), h, h == top[-1][0]))
    return sorted(out, key=repr)


def found(docs):
    got = merkle.verified(merkle.manifest(docs, merkle.without_newlines()))
    return sorted([tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


def test_awkward_rows(awkward, awkward_rows):
    assert found(awkward) == brute(awkward_rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 4], [9, 10, 1, 2], [28, 1, 1, 1]])
def test_trees_of_every_shape(spark, sizes):
    rows = [(1000 * k + i, f"line {i}\nline", "en", f"s{k}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    assert found(spark.createDataFrame(rows, DOCUMENTS)) == brute(rows)


def test_any_change_of_a_document_is_seen_and_repeated_rows_count(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(20)] + [(5, "text 5", "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, DOCUMENTS)
    root = merkle.manifest(docs).first()["root"]
    for change in [F.col("text") + F.lit("."), None]:
        other = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("text"))) if change is None else docs.withColumn("lang", F.when(F.col("doc_id") == 9, F.lit("de")).otherwise(F.col("lang")))
        assert merkle.manifest(other).first()["root"] != root
    assert merkle.manifest(docs.distinct()).first()["root"] != root
    assert merkle.manifest(docs.repartition(7)).first()["root"] == root


def test_other_arities_fold_to_the_root(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 4).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    for arity in (2, 5):
        got = merkle.verified(merkle.manifest(docs, F.col("text"), arity)).agg(F.count("*"), F.min("verified"), F.count_distinct("root")).first()
        assert tuple(got) == (50, True, 1)


def test_an_empty_table(nothing):
    assert found(nothing) == []
