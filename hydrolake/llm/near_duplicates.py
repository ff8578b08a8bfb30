"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text is its set of five-word shingles. Each of TREES trees orders the texts by a signature of MinHash values; texts
meet in a tree's trie at the node of their common prefix. The matched prefix is shortened from LONGEST values on until a
pair at the threshold meets in some tree with probability TARGET. What meets is then compared exactly.

Texts with equal shingle sets are one class with a weight, found by a hash of the set, and only its first row goes on. A
node of at most SMALL classes gives its pairs. Larger nodes are near copies of one text; nodes that share classes are
joined to groups, and each group is compared in blocks against blocks, which return counts of links and spanning
edges, not pairs. Every pair that meets is compared once.

Result: one row per input row with class_id, the smallest id among all rows that chains of links connect, and
n_links, the number of other rows whose similarity to it is THRESHOLD or more (copies included).

Defined cases: a text of one to four words is one shingle of all its words; a null or empty text has no links and is
its own class; repeated rows are copies of each other; a null id takes part, and class_id is null where all ids are;
an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.common import blocks_of, flat, mix, stored, word_hashes
from hydrolake.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
TREES = 20
LONGEST = 8
TARGET = 0.999
SMALL = 32
#: Classes of a group compared in one task with as many others.
GROUP_BLOCK = 512
COLUMNS = 4096

_rng = np.random.default_rng(99)
_ODD = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(1, 1 << 31, TREES * LONGEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, TREES * LONGEST, dtype=np.uint32)
_LEVEL = _rng.integers(1, 1 << 62, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = TARGET) -> int:
    """The longest matched prefix at which the forest's recall reaches the target for a pair at the threshold."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit shingles of each text, and the first of each text (one more than texts)."""
    hashes, first, _, _ = word_hashes(data, offs)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for k in range(WORDS):
        total += padded[k : k + len(hashes)] * _ODD[k]
    valid = np.arange(len(hashes)) + WORDS <= first[1:][owner.astype(np.int64)]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    at = first[:-1][short]
    valid[at] = True
    total[at] = 0
    for k in range(WORDS - 1):
        there = k < n_words[short]
        total[at[there]] += hashes[at[there] + k] * _ODD[k]
    kept = np.unique(owner[valid] << np.uint64(32) | mix(total[valid]) >> np.uint64(32))
    return kept.astype(np.uint32), np.searchsorted(kept, np.arange(len(offs), dtype=np.uint64) << np.uint64(32))


def prefixes(found: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Trie node of each text (rows, those with shingles only) in each tree."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), TREES), np.uint64)
    if len(starts):
        x = (mix(found.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        for tree in range(TREES):
            node = np.full(len(starts), tree + 1, np.uint64)
            for level in range(depth):
                j = tree * LONGEST + level
                node = mix(node * _LEVEL[level] + np.minimum.reduceat((x ^ _FLIP[j]) * _FACTOR[j], starts))
            out[:, tree] = node
    return out.view(np.int64)


SIGNED = "doc_id long, text_hash long, k1 long, k2 long, n int, nodes array<long>, shingles binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(2))
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                found, first = shingles(data[part[0] : part[-1]], part - part[0])
                n = np.diff(first)
                nodes = np.zeros((b - a, TREES), np.int64)
                nodes[n > 0] = prefixes(found, first, depth)
                wide = mix(found.astype(np.uint64))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(w)]) for w in (wide, mix(wide + np.uint64(1)))]
                k1, k2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * TREES, TREES), pa.int32()), pa.array(nodes.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(k1), pa.array(k2), pa.array(n, pa.int32()), lists, raw.cast(pa.binary())],
                    names=["doc_id", "text_hash", "k1", "k2", "n", "nodes", "shingles"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, SIGNED).withColumn("rid", F.monotonically_increasing_id())


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _links(together: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return together >= threshold * (na[:, None] + nb[None, :] - together) - 1e-9


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a (rows) and b (columns), from shingles that both sides hold."""
    sa, sb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(sa, sb)
    oa, ob = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ia, ib = np.searchsorted(common, sa), np.searchsorted(common, sb)
    in_a, in_b = common[np.minimum(ia, len(common) - 1)] == sa if len(common) else np.zeros(len(sa), bool), common[np.minimum(ib, len(common) - 1)] == sb if len(common) else np.zeros(len(sb), bool)
    oa, ia, ob, ib = oa[in_a], ia[in_a], ob[in_b], ib[in_b]
    order_a, order_b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    oa, ia, ob, ib = oa[order_a], ia[order_a], ob[order_b], ib[order_b]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, o, i in ((ma, oa, ia), (mb, ob, ib)):
            s = slice(*np.searchsorted(i, [low, low + width]))
            m[o[s], i[s] - low] = 1
        out += ma @ mb.T
    return out


def compare_group(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of a block pair of one group: links of each class, and an edge to the smallest class it hangs together with."""
    x, y = int(g["x"].iloc[0]), int(g["y"].iloc[0])
    a = g[g["block"] == x].reset_index(drop=True)
    b = a if x == y else g[g["block"] == y].reset_index(drop=True)
    empty = pd.DataFrame({"rid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    if not len(a) or not len(b):
        return empty
    sets_a, sets_b = ([np.frombuffer(s, np.uint32) for s in part["shingles"]] for part in (a, b))
    linked = _links(overlaps(sets_a, sets_b), a["n"].to_numpy(float), b["n"].to_numpy(float), threshold)
    if x == y:
        np.fill_diagonal(linked, False)
    wa, wb = a["weight"].to_numpy(np.int64), b["weight"].to_numpy(np.int64)
    ra, rb = a["rid"].to_numpy(np.int64), b["rid"].to_numpy(np.int64)
    most = np.iinfo(np.int64).max
    la, lb = ra.copy(), rb.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], most).min(axis=1))
        nb = na if x == y else np.minimum(lb, np.where(linked, na[:, None], most).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    rows = [(ra, (linked * wb[None, :]).sum(axis=1), la)]
    if x != y:
        rows.append((rb, (linked * wa[:, None]).sum(axis=0), lb))
    out = pd.concat([pd.DataFrame({"rid": r, "links": n, "root": root}) for r, n, root in rows])
    return out[out["links"] > 0]


@F.arrow_udf(T.LongType())
def common_shingles(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([
        len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True))
        for x, y in zip(a.to_pylist(), b.to_pylist())
    ], pa.int64())


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every row, with text_hash and ``first``, true for one row of each class."""
    depth = matched_depth(threshold, TREES, LONGEST, target)
    signed = stored(signatures(docs, id_col, text_col, depth))
    worded = signed.where("n > 0")
    # classes of equal shingle sets, with their first row
    classes = stored(worded.groupBy("k1", "k2", "n").agg(F.count("*").alias("weight"), F.min("rid").alias("rid"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("least")))
    firsts = classes.select("rid", "weight")
    nodes = worded.select("rid", "n", "nodes").join(firsts.select("rid"), "rid").select("rid", "n", F.explode("nodes").alias("node"))
    met = nodes.groupBy("node").agg(F.count("*").alias("m"), F.min("rid").alias("lead")).where("m > 1")
    met = stored(nodes.join(met, "node"))
    group = components(met.where(F.col("m") > SMALL).select(F.col("rid").alias("a"), F.col("lead").alias("b")))
    group = stored(group.select(F.col("node").alias("rid"), F.col("root").alias("g")))

    # pairs of small nodes, but for those inside a group
    members = F.array_sort(F.collect_list(F.struct("rid", "n")))
    alike = lambda x, y: F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"]) - 1e-9
    pairs_of = lambda s: F.flatten(F.transform(s, lambda x, i: F.transform(
        F.filter(F.slice(s, i + 2, SMALL), lambda y: alike(x, y)), lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b")))))
    small = met.where(F.col("m") <= SMALL).groupBy("node").agg(members.alias("s"))
    pairs = small.select(F.explode(pairs_of(F.col("s"))).alias("p")).select("p.a", "p.b").distinct()
    pairs = (
        pairs.join(group.select(F.col("rid").alias("a"), F.col("g").alias("ga")), "a", "left")
        .join(group.select(F.col("rid").alias("b"), F.col("g").alias("gb")), "b", "left")
        .where("ga is null or gb is null or ga != gb").select("a", "b")
    )
    sets = signed.select("rid", "n", "shingles").join(firsts, "rid")
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("weight").alias(f"w{x}"), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("c", common_shingles("sa", "sb"))
    linked = stored(both.where(F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c")) - 1e-9).select("a", "b", "wa", "wb"))

    # groups, block against block
    blocks = group.groupBy("g").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias("blocks"))
    placed = sets.join(group, "rid").join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("g", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rid", "n", "weight", "shingles")
    compared = stored(placed.groupBy("g", "x", "y").applyInPandas(lambda g: compare_group(g, threshold), "rid long, links long, root long"))

    root = components(linked.select("a", "b").unionByName(compared.where("rid != root").select(F.col("rid").alias("a"), F.col("root").alias("b"))))
    links = (
        linked.select(F.col("a").alias("rid"), F.col("wb").alias("links"))
        .unionByName(linked.select(F.col("b").alias("rid"), F.col("wa").alias("links")))
        .unionByName(compared.select("rid", "links")).groupBy("rid").agg(F.sum("links").alias("links"))
    )
    rooted = (
        classes.join(root.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left")
        .withColumn("root", F.coalesce("root", "rid")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    )
    rooted = stored(rooted.select("k1", "k2", "n", "least", "root", "n_links"))
    top = rooted.groupBy("root").agg(F.min("least").alias("top"))
    found = rooted.join(top, "root").select("k1", "k2", "n", "n_links", "top")
    rows = signed.select("rid", "doc_id", "text_hash", "k1", "k2", "n").join(found, ["k1", "k2", "n"], "left")
    own = F.col("n") == 0
    return rows.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"), "text_hash",
        (own | (F.col("rid") == F.col("top.rid"))).alias("first"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row of each class: that of the smallest id. Texts without words all stay."""
    kept = stored(joined(docs, id_col, text_col).select("doc_id", "text_hash", "first", F.col("n_shingles").alias("n")))
    keep = kept.where("first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    out = docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (text_hash(F.col(text_col)) == F.col("_hash")), "left_semi")
    repeated = kept.where("n > 0").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    # equal rows are copies too; those without words stay as often as they are there
    if repeated:
        worded = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t-\r]+", "")) > 0
        out = out.where(worded).dropDuplicates([id_col, text_col]).unionByName(out.where(~F.coalesce(worded, F.lit(False))))
    return out
