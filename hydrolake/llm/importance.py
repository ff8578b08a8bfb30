"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are counts of hashed byte N-grams in BUCKETS buckets, one added to each. The raw model counts every
document; the target model counts at most TARGET_ROWS documents labelled 1, the least by a hash of their id. A
document's log weight is the sum over its n-grams of log target less log raw probability. Adding Gumbel noise from a hash
of the id and keeping the k largest keys draws k documents without replacement in proportion to their weights.

k follows from the labels: all documents but REJECT of the share that is labelled 0. The k-th key is found by counting
keys in ever finer ranges, so no task or driver holds the keys.

Defined cases: a null, empty or very short text has no n-grams and log weight 0; without any label of either kind
every document is kept; equal keys are ordered by id, null first, and rows equal in both are kept together; a document
with several labels counts by the least of them, null labels are ignored; an empty table gives an empty result.
All columns of the input stay; of the same names, the operator's replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import blocks_of, flat, mix, stored

N = 4
BUCKETS = 1 << 16
TARGET_ROWS = 20_000
REJECT = 0.8
#: Ranges counted at once when the k-th key is sought, and keys that are then ordered.
RANGES = 4096
FEW = 10_000

ADDED = ("n_grams", "log_weight", "sample_key", "score", "kept")


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and the first n-gram of each text (one more than texts)."""
    n = len(data) - N + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    x = np.zeros(n, np.uint64)
    for k in range(N):
        x = (x << np.uint64(8)) | data[k : k + n]
    whole = np.ones(n, bool)
    for k in range(1, N):  # grams that reach into the next text
        cut = offs[1:-1] - k
        whole[cut[(cut >= 0) & (cut < n)]] = False
    buckets = (mix(x[whole]) >> np.uint64(48)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(whole)])
    return buckets, before[np.minimum(offs, n)]


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """bucket, raw, target: n-grams of all rows and of those with ``_target``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offs = flat(batch.column(0))
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                found, first = grams(data[part[0] : part[-1]], part - part[0])
                total[0] += np.bincount(found, minlength=BUCKETS)
                total[1] += np.bincount(found[np.repeat(chosen[a:b], np.diff(first))], minlength=BUCKETS)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[0][there]), pa.array(total[1][there])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(text_col).alias("text"), "_target").mapInArrow(count, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          quality: str = "quality", target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the share of rows to keep."""
    per_id = labels.where(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(quality).alias("_q"))
    good, bad = per_id.agg(F.count(F.when(F.col("_q") > 0, 1)), F.count(F.when(F.col("_q") <= 0, 1))).first()
    if not good or not bad:
        return np.zeros(BUCKETS), 1.0
    # at most target_rows ids: a broadcast of bounded size
    chosen = per_id.where("_q > 0").orderBy(F.xxhash64("_id"), "_id").limit(target_rows).select("_id", F.lit(True).alias("_target"))
    marked = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"), "left").withColumn("_target", F.coalesce("_target", F.lit(False)))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in _counted(marked, text_col).collect():  # one row per bucket
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return (ratio if target.sum() > BUCKETS else np.zeros(BUCKETS)), 1 - REJECT * bad / (good + bad)


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_grams, log_weight, sample_key (log weight with Gumbel noise) and score (0 to 1, from the mean)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("n long, w double")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offs = flat(texts)
            n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                found, first = grams(data[part[0] : part[-1]], part - part[0])
                n[a:b] = np.diff(first)
                owner = np.repeat(np.arange(b - a), n[a:b])
                w[a:b] = np.bincount(owner, weights=shared.value[found], minlength=b - a)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(w)], ["n", "w"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    found = docs.select(*kept, look(F.col(text_col)).alias("_w"), (-F.log(-F.log(uniform))).alias("_noise"))
    w, n = F.col("_w.w"), F.col("_w.n")
    return found.select(*kept, n.alias("n_grams"), w.alias("log_weight"), (w + F.col("_noise")).alias("sample_key"),
                        (1 / (1 + F.exp(-4 * w / F.greatest(n, F.lit(1))))).alias("score"))


def _narrowed(rows: DataFrame, k: int) -> tuple[DataFrame, int, int, float, float]:
    """Rows around the k-th largest key, at most FEW or all of one key; k among them, their number, least and largest key."""
    n, low, high = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    while n > FEW and high > low:
        width = high / RANGES - low / RANGES
        cell = F.least(F.lit(RANGES - 1), F.floor((F.col("key") - low) / width)).alias("cell")
        counts = rows.groupBy(cell).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(counts, key=lambda r: -r["cell"]):
            if k <= r["n"]:
                n, low, high = r["n"], r["a"], r["b"]
                break
            k -= r["n"]
        rows = rows.where(F.col("key").between(low, high))
    return rows, k, n, low, high


def kth_key(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """The k-th of (key descending, id ascending, null first), exactly; None from the last row on. keys: columns key, id."""
    if k >= keys.count():
        return None
    rows, k, n, low, high = _narrowed(keys, k)
    if n > FEW:  # all of one key: the id decides, sought in the same way
        nulls = rows.where("id is null").count()
        if k <= nulls:
            return low, None
        rows, k, n, first, last = _narrowed(rows.where("id is not null").select((-F.col("id").cast("double")).alias("key"), "id"), k - nulls)
        if n > FEW:  # repeated rows
            return low, rows.agg(F.min("id")).first()[0]
        return low, rows.orderBy("id").limit(k).orderBy(F.desc("id")).first()["id"]
    row = rows.orderBy(F.desc("key"), F.asc_nulls_first("id")).limit(k).orderBy("key", F.desc_nulls_last("id")).first()
    return row["key"], row["id"]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
             quality: str = "quality") -> DataFrame:
    """The input with n_grams, log_weight, sample_key, score and kept."""
    ratio, share = learn(docs, labels, id_col, text_col, label_id, quality)
    weighed = weigh(docs, ratio, id_col, text_col)
    if share >= 1:
        return weighed.withColumn("kept", F.lit(True))
    keys = stored(weighed.select(F.col("sample_key").alias("key"), F.col(id_col).cast("long").alias("id")))
    edge = kth_key(keys, max(1, int(np.ceil(share * keys.count()))))
    if edge is None:
        return weighed.withColumn("kept", F.lit(True))
    key, last = edge
    tie = F.col(id_col).isNull() if last is None else F.col(id_col).isNull() | (F.col(id_col) <= last)
    return weighed.withColumn("kept", (F.col("sample_key") > key) | ((F.col("sample_key") == key) & tie))
