"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against it into phrases, each the longest
match with some substring of the language's text; the language that needs fewest phrases for the text's length wins.
Letters are lower-cased, everything else is a gap of length one. A text is parsed in blocks of BLOCK symbols, at whose
ends phrases end too, so that a worker parses many blocks in step, each symbol of each one by a table look-up.

The alphabet is all letters of all samples. Moves of a language's states lie in one array: a state is a place in it, no
two states the same, and its move by symbol c lies c places on, marked with the state, where no other state has one.

Learning: at most SAMPLE_ROWS rows of each language, the least by a hash of their id, with SAMPLE_CHARS characters from
the middle of each. That sample is the only bounded thing here; every whole text is parsed.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; languages that fit equally well: the first
in code point order; with nothing learned every text is ``und``; a single learned language has score 1; letters that the
sample lacks are phrases of their own. All columns of the input stay; of the same names, these replace the input's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolake.llm.common import blocks_of, flat

SAMPLE_ROWS = 64
SAMPLE_CHARS = 320
CODES = 0x110000
BLOCK = 512
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    letters: str  # symbols 1.. in this order; 0 is a gap, then one for other letters
    table: np.ndarray  # state + symbol -> state << 32 | next state; elsewhere another state or -1 stands in front
    roots: np.ndarray


@cache
def folded() -> tuple[np.ndarray, np.ndarray]:
    """Code points of all letters, and of their lower case."""
    codes = [c for c in range(CODES) if chr(c).isalpha()]
    return np.array(codes), np.array([ord(chr(c).lower()[0]) for c in codes])


def symbol_table(letters: str) -> np.ndarray:
    codes, lower = folded()
    index = np.full(CODES, len(letters) + 1, np.int32)
    index[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    out = np.zeros(CODES, np.int32)
    out[codes] = index[lower]
    return out


def symbols(data: bytes, offs: np.ndarray, lut: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts with runs of non-letters as one gap, their offsets, and which texts have letters."""
    codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    places = lead[offs] if lead[-1] == len(codes) else None
    if places is None:
        raise ValueError("text is not valid UTF-8")
    found = lut[codes]
    letter = found > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begins = places[:-1][places[:-1] < len(codes)]
    keep[begins] = letter[begins]
    kept = np.concatenate([[0], np.cumsum(keep)])
    had = np.concatenate([[0], np.cumsum(letter)])
    return found[keep], kept[places], (had[places[1:]] - had[places[:-1]]) > 0


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Moves of the suffix automaton of a symbol string, as in Model.table with the root at 0."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return laid_out(step, width)


def laid_out(step: list[dict[int, int]], width: int) -> np.ndarray:
    """The root has a move by every symbol; by one that the language lacks to a last state without moves."""
    lacking = len(step)
    most = 2 * width + 2 * sum(len(moves) + 1 for moves in step)
    free, unused = bytearray(b"\1") * most, bytearray(b"\1") * most
    place = [0] * (lacking + 1)
    free[:width], unused[0] = bytes(width), 0
    at, filled = width, 0
    for s in sorted(range(1, lacking), key=lambda s: -len(step[s])):
        moves = sorted(step[s])
        if len(moves) < 2 and not filled:
            at = filled = width  # states of one move take what is left from the front
        if not moves:
            break
        low = moves[0]
        while True:
            at = free.find(1, at)
            grown = at + 2 * width - len(free)
            if grown > 0:
                free += b"\1" * (grown + len(free))
                unused += b"\1" * (len(free) - len(unused))
            p = at - low
            if unused[p] and all(free[p + c] for c in moves):
                break
            at += 1
        for c in moves:
            free[p + c] = 0
        unused[p], place[s] = 0, p
        at += len(moves) > 1
    rest, p = [s for s in range(1, lacking + 1) if s == lacking or not step[s]], 0
    for s in rest:
        p = unused.find(1, p)
        if p < 0:
            p = len(unused)
            unused += b"\1" * len(rest)
        unused[p], place[s] = 0, p
    table = np.full(max(max(place), free.rfind(0)) + width + 1, -1, np.int64)
    table[:width] = place[lacking]
    for s, moves in enumerate(step):
        for c, t in moves.items():
            table[place[s] + c] = place[s] << 32 | place[t]
    return table


def joined_model(tables: dict[str, np.ndarray], letters: str) -> Model:
    """One look-up table over the languages' automata: a miss ends a phrase, and the next begins with its symbol."""
    parts, roots, base = [], [], 0
    for language in sorted(tables):
        t = tables[language]
        parts.append(np.where(t < 0, -1, t + (base << 32 | base)))
        roots.append(base)
        base += len(t)
    return Model(sorted(tables), letters, np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(roots, np.int64))


def sample(docs: DataFrame, text: Column, lang: Column, key: Column) -> DataFrame:
    """lang, slice: SAMPLE_ROWS rows of each language; the rank is cut on the map side."""
    middle = F.greatest(F.lit(1), F.floor((F.length(text) - SAMPLE_CHARS) / 2).cast("int"))
    rows = docs.where(text.isNotNull() & lang.isNotNull()).select(
        lang.cast("string").alias("lang"), text.substr(middle, F.lit(SAMPLE_CHARS)).alias("slice"), F.xxhash64(key, F.lit("lang")).alias("h")
    )
    least = Window.partitionBy("lang").orderBy("h", "slice")
    return rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= SAMPLE_ROWS).select("lang", "slice").distinct()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    chosen = sample(docs, F.col(text_col), F.col(lang_col), F.col(id_col)).persist()

    @F.arrow_udf("array<string>")
    def letters_of(slices: pa.Array) -> pa.Array:
        return pa.array([sorted({c.lower()[0] for c in x if c.isalpha()}) for x in slices.to_pylist()], pa.list_(pa.string()))

    letters = "".join(sorted(r["c"] for r in chosen.select(F.explode(letters_of("slice")).alias("c")).distinct().collect()))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(g["slice"])
        data = " ".join(parts).encode()
        found, _, _ = symbols(data, np.array([0, len(data)]), symbol_table(letters), len(letters) + 1)
        t = automaton(found, len(letters) + 3).astype("<i8")
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "table": [zlib.compress(t.tobytes(), 1)]})

    rows = chosen.groupBy("lang").applyInPandas(build, "lang string, table binary").collect()
    chosen.unpersist()
    return joined_model({r["lang"]: np.frombuffer(zlib.decompress(r["table"]), "<i8") for r in rows}, letters)


def phrase_counts(model: Model, found: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    sizes = np.diff(offs)
    n_blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), n_blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = offs[:-1][owner] + nth * BLOCK
    length = np.minimum(BLOCK, offs[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    n = len(owner)
    out = np.zeros((len(sizes), len(model.roots)), np.int64)
    if not n:
        return out
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # blocks longer than t
    state = np.repeat(model.roots[:, None], n, axis=1)
    ended = np.zeros((len(model.roots), n), np.int32)
    for t in range(int(length[0])):
        k = int(active[t])
        s, c = state[:, :k], found[begin[:k] + t].astype(np.int64)
        v = model.table.take(s + c)
        miss = (v >> 32) != s
        ended[:, :k] += miss
        state[:, :k] = np.where(miss, model.table.take(model.roots[:, None] + c), v) & 0xFFFFFFFF
    for language in range(len(model.roots)):
        out[:, language] = np.bincount(owner, weights=ended[language] + 1, minlength=len(sizes))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (1 less the winner's share of the second's phrases; 0 undecided, 1 clear)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        lut, names = symbol_table(m.letters), np.array([*m.languages, UNKNOWN], object)
        for texts in batches:
            data, offs = flat(texts)
            pred, score = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            for a, b in blocks_of(offs, 1 << 22) if m.languages else ():
                part = offs[a : b + 1]
                found, places, lettered = symbols(data[part[0] : part[-1]].tobytes(), part - part[0], lut, len(m.letters) + 1)
                counts = phrase_counts(m, found, places)
                best = counts.argmin(axis=1)
                least = np.partition(counts, min(1, counts.shape[1] - 1), axis=1)
                clear = 1 - least[:, 0] / np.maximum(least[:, 1], 1) if counts.shape[1] > 1 else np.ones(b - a)
                pred[a:b] = np.where(lettered, best, len(m.languages))
                score[a:b] = np.where(lettered, clear, 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[pred].tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = docs.select(*kept, parse(F.col(text_col)).alias("_found"))
    return found.select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
