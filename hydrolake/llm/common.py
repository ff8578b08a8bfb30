"""Helpers shared by the operators: tables, checkpoints, and word hashing over whole Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.session import apply_runtime, shared_folder

#: Rows that reach a Python worker at once; texts may be long.
ARROW_ROWS = "512"


def prepared(spark: SparkSession) -> SparkSession:
    apply_runtime(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads back: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str) -> Column:
    """crc32(id as text) mod 5; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of an ASCII text, bit by bit; null for null."""
    bits = f"flatten([[(ord(({text})[i]) >> k) & 1 for k in range(8)] for i in range(1, len({text}) + 1)])"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295)"


# ---- words of a batch, hashed without a Python string per word -------------------------------------

_SEED = np.random.default_rng(20240501)
_RADIX = 0x9E3779B97F4A7C15 | 3
_BLOCK = 1 << 21


def _byte_codes() -> np.ndarray:
    codes = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


CODES = _byte_codes()
#: Bytes that part words: blank and \t..\r.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside [0-9A-Za-z\x80-\xff]; all code points from U+0080 on consist of bytes from \x80 on.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < n + 1:
        inverse = pow(_RADIX, -1, 1 << 64)
        for key, base in (("n", _RADIX), ("inv", inverse)):
            p = np.full(max(n, _BLOCK) + 1, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["n"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks_of(offs: np.ndarray, most: int = _BLOCK):
    """Ranges (a, b) of texts that hold about ``most`` bytes together; a longer text stands alone."""
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offs: np.ndarray, parts: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, first word of each text (one more than texts), start and end bytes.

    A word is a longest run of bytes that do not part words; A-Z are hashed as a-z.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), z, z
    inside = np.empty(n + 1, bool)
    np.logical_not(parts[data], out=inside[:n])
    inside[n] = False
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    borders = offs[:-1][offs[:-1] < n]
    begin[borders] = inside[borders]
    starts = np.flatnonzero(begin)
    ends_mask = inside[:n] & ~inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends_mask[last] |= inside[last]
    ends = np.flatnonzero(ends_mask) + 1
    power, inverse = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(CODES[data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offs), starts, ends


def word_hash(word: str) -> int:
    raw = word.encode()
    return int(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0])


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for a text without any."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
