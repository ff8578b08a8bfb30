"""Context-triggered piecewise hashing of documents.

A rolling hash over WINDOW bytes ends a chunk wherever its lowest k bits are ones, so chunks depend on nearby bytes
only and an edit changes few of them. Each chunk gives one of 64 characters, from the sum of its mixed rolling hashes.
The block size 2^k is the largest that still yields FEWEST chunks; a fingerprint is ``2^k:signature:signature at 2^(k+1)``.
From its 64th character on a signature's chunk runs to the end of the text, so the whole text counts and the length
is bounded. Two fingerprints are compared at each block size both have: one less the edit distance over the longer
length, 0 where the signatures have no common run of COMMON characters; the best of them counts.

``fingerprint_edits`` fingerprints each text and the same text with its last quarter replaced by the head of the next
document in id order. Documents are range-partitioned and sorted by id, so the next one is the next row of the same
task; only the first and last rows of the tasks meet in a second, narrow step.

Defined cases: null text is empty; an empty text has the fingerprint ``4::``; equal fingerprints have likeness 1; a null
id sorts first; equal ids follow in order of their text's hash; a single document is its own next; an empty table gives
an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import stored

WINDOW = 7
FEWEST = 32
MOST = 64
LEAST_BITS = 2
COMMON = 7
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CODES = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _signature(ends: np.ndarray, sums: np.ndarray) -> str:
    """ends: bytes that end a chunk; sums: running sum of the mixed hashes, from 0."""
    n = len(sums) - 1
    if not n:
        return ""
    cuts = ends[: MOST - 1] + 1
    if not len(cuts) or cuts[-1] < n:
        cuts = np.append(cuts, n)
    chunk = np.diff(sums[np.concatenate([[0], cuts])])
    return DIGITS[(chunk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return f"{1 << LEAST_BITS}::"
    code = CODES[b]
    roll = code.copy()
    factor = 1
    for j in range(1, min(WINDOW, len(code))):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        roll[j:] += code[: len(code) - j] * np.uint32(factor)
    roll = _mixed(roll)
    free = ~roll
    low = (free & -free).astype(np.float64)  # the lowest zero bit of the hash
    ones = np.where(low > 0, np.frexp(low)[1] - 1, 32)
    at_least = np.cumsum(np.bincount(ones, minlength=34)[::-1])[::-1]
    k = max(LEAST_BITS, int(np.flatnonzero(at_least >= FEWEST)[-1]) if at_least[0] >= FEWEST else 0)
    sums = np.concatenate([[0], np.cumsum(_mixed(roll ^ np.uint32(0x5BD1E995)).astype(np.uint64))])
    return f"{1 << k}:{_signature(np.flatnonzero(ones >= k), sums)}:{_signature(np.flatnonzero(ones >= k + 1), sums)}"


def _shared_run(a: Column, b: Column) -> Column:
    run = F.least(F.lit(COMMON), F.length(a), F.length(b))
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - run + 1), lambda i: F.substring(s, i, run))
    return F.when(run == 0, F.length(a) == F.length(b)).otherwise(F.arrays_overlap(grams(a), grams(b)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; 0 at incompatible block sizes."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    ka, kb = pa_[0].cast("long"), pb[0].cast("long")

    def near(x: Column, y: Column) -> Column:
        n = F.greatest(F.length(x), F.length(y), F.lit(1))
        return F.when(_shared_run(x, y), 1 - F.levenshtein(x, y) / n).otherwise(0.0)

    return (
        F.when(a == b, 1.0)
        .when(ka == kb, F.greatest(near(pa_[1], pb[1]), near(pa_[2], pb[2])))
        .when(ka == 2 * kb, near(pa_[1], pb[2]))
        .when(2 * ka == kb, near(pa_[2], pb[1]))
        .otherwise(0.0)
    )


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, place int, text string"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in FOUND.split(", ")]


def _compared(doc: int | None, text: str, print_: str, after: str, after_print: str) -> tuple:
    k = len(text) // 4
    edited = text[: len(text) - k] + after[:k]
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc, len(text), digest, print_, print_ if edited == text else fingerprint(edited), after_print, 0, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(TYPES), TYPES)], names=NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each finished by its successor; the task's first (place 1) and last (2) row also go out raw."""
    held = None
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            mark = fingerprint(text)
            if held is None:
                rows.append((doc, len(text), None, mark, None, None, 1, text))
            else:
                rows.append(_compared(*held, text, mark))
            held = (doc, text, mark)
        yield _batch(rows)
    if held is not None:
        yield _batch([(held[0], len(held[1]), None, held[2], None, None, 2, held[1])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_compared(*row) for row in zip(*(c.to_pylist() for c in batch.columns))])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # by text too, so that rows of one id, such as null, are spread
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    walked = stored(ordered.mapInArrow(_walk, FOUND).withColumn("task", F.spark_partition_id()))
    ends = walked.where("place > 0").select("doc_id", "task", "place")
    # two rows per task: a last row's successor is the first row of the next task, of the last task that of the first
    order = Window.orderBy("task", "place")  # tasks ascend as their ranges do
    first = F.first(F.struct("task", "place")).over(order)
    pairs = (
        ends.withColumn("after", F.coalesce(F.lead(F.struct("task", "place"), 1).over(order), first))
        .where("place = 2").select("task", F.col("after.task").alias("after_task"))
    )
    last = walked.where("place = 2").select("task", "doc_id", "text", "fingerprint")
    head = walked.where("place = 1").select(F.col("task").alias("after_task"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    met = last.join(pairs, "task").join(head, "after_task").select("doc_id", "text", "fingerprint", "after", "after_print")
    whole = walked.where("place = 0").drop("task").unionByName(met.mapInArrow(_finish, FOUND))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
