"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Each document becomes its token ids and one end id. Only longer documents than a sequence are cut, into whole
sequences and a rest. Pieces are dealt by a hash of their document into groups of about GROUP documents, each packed
in a task of its own; a group wastes less than one sequence. Within a group a sequence is filled greedily, the longest
piece that fits first; then its shortest piece goes back to the pool if two pieces still unpacked fill the gap so
expanded more tightly.

Tokenising: runs between blanks, tabs and line feeds are encoded apart, as the vocabulary's rules never reach
across white space, and kept in a bounded dictionary of each worker. Runs of plain characters, which the vocabulary's
normaliser leaves as they are, are parted into words by its pattern and only new words encoded; other runs, and texts
in which lower case before composition differs from lower case after it, go through the tokenizer's every step.

Defined cases: a null or empty text is its end id alone; a null document id is a document of its own; repeated rows are
packed as often as they occur; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 0
#: Documents packed by one task.
GROUP = 30_000
#: Encoded runs that a worker keeps; the dictionary starts anew beyond.
KEPT_RUNS = 1_200_000
#: Characters whose runs are held at once.
HELD_CHARS = 2_000_000
#: Letters whose lower case depends on their place; texts with them are left to the tokenizer as they are.
UNLIKE = "\u03a3\u0130"

#: The steps before BPE for which plain runs have a shorter way.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
WORD_END = "</w>"


def _plain_letters() -> str:
    """Small letters of Latin, Greek, Cyrillic and Armenian; neither alone nor side by side are they changed by NFC or lower case."""
    small = (chr(c) for c in range(0xDF, 0x590))
    return "a-z" + "".join(c for c in small if unicodedata.category(c) == "Ll" and unicodedata.normalize("NFC", c) == c == c.lower())


_LETTERS = _plain_letters()
#: Runs of ASCII without capitals and "<", which begins special tokens, and of those letters; and their words.
PLAIN = re.compile(f"[!-;=-@\\[-`{{-~{_LETTERS}]+")
WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


def _byte_letters() -> str:
    """The letter by which byte-level BPE writes each byte; a blank is kept, as it parts words."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256)).replace("\u0120", " ")


BYTE_LETTERS = _byte_letters()

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _h long"


class Encoder(dict):
    """Bytes of a run's ids (little-endian, 32 bits), encoded on first sight, many runs at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # a special token parts the runs that are encoded together; runs that hold its text go alone
        parting = max(((a.content, i) for i, a in self.tokenizer.get_added_tokens_decoder().items() if a.special), default=(None, -1), key=lambda x: x[1])
        self.parting, self.parting_id = parting
        self.special = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = self._words()
        self[""] = b""

    def _words(self):
        """A tokenizer of byte letters between blanks, by the same merges; none if the file's steps are others."""
        from tokenizers import Tokenizer

        steps = json.loads(self.tokenizer.to_str())
        model = steps["model"]
        if (
            steps["normalizer"] != NORMALIZER or steps["pre_tokenizer"] != PRE_TOKENIZER or model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END
            or any(model[x] for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")) or any("<" != x[0] for x in self.special)
            or any(c not in model["vocab"] or c + WORD_END not in model["vocab"] for c in BYTE_LETTERS.replace(" ", "\u0120"))
        ):
            return None
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for x, i in model["vocab"].items() if x.endswith(WORD_END)]] = True
        return Tokenizer.from_str(json.dumps({**steps, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))

    def learn_words(self, words: list[str]) -> None:
        """Words of plain runs; each one's last id, and no other, is that of a word's end."""
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            lines = [codecs.charmap_decode(" ".join(part[k : k + 512]).encode(), "strict", BYTE_LETTERS)[0] for k in range(0, len(part), 512)]
            ids = np.concatenate([np.array(found.ids, "<u4") for found in self.words.encode_batch_fast(lines, add_special_tokens=False)])
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("a word reaches beyond its place")
            self.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def learn(self, new: set[str]) -> None:
        """Encodes runs that are not kept yet."""
        if len(self) + len(new) > KEPT_RUNS:
            self.clear()
            self[""] = b""
        # flat lists: many small containers would have the collector walk the whole dictionary again and again
        alone, together, plain, words, counts = [], [], [], [], []
        for r in new:
            if self.words is not None and PLAIN.fullmatch(r):
                found = WORD.findall(r)
                plain.append(r)
                words += found
                counts.append(len(found))
            elif self.parting is None or "<" in r:
                alone.append(r)
            else:
                together.append(r)
        self.learn_words([w for w in set(words) if w not in self])
        at = 0
        for r, n in zip(plain, counts):
            if n > 1:
                self[r] = b"".join([self[w] for w in words[at : at + n]])
            at += n
        for run, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self[run] = np.array(found.ids, "<u4").tobytes()
        parts = [together[at : at + 256] for at in range(0, len(together), 256)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([self.parting.join(x) for x in parts], add_special_tokens=False) if parts else ()):
            ids = np.array(found.ids, "<u4")
            raw, ends = ids.tobytes(), [*np.flatnonzero(ids == self.parting_id).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("a run reaches beyond its place")
            at = 0
            for run, end in zip(part, ends):
                self[run] = raw[4 * at : 4 * end]
                at = end + 1

    def lowers(self, part: str, small: str) -> bool:
        """Whether the tokenizer finds the same in the text in lower case: no letter's case depends on its place,
        none composes only in lower case, and no special token appears only then."""
        return (
            not any(c in part for c in UNLIKE)
            and unicodedata.is_normalized("NFC", small)
            and not ("<" in small and any(part.count(x) != small.count(x) for x in self.special))
        )

    def ids(self, texts: list[str]) -> list[bytes]:
        """The whole texts' ids; long texts are cut at blanks, so that few runs are held at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str], list[bytes | None]]] = []
        size = 0

        def flush() -> None:
            self.learn({run for _, runs, coded in held for run, found in zip(runs, coded) if found is None})
            for k, runs, coded in held:
                out[k].append(b"".join([self[run] if found is None else found for run, found in zip(runs, coded)]))
            held.clear()

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = at + HELD_CHARS
                if end < len(text):
                    end = text.find(" ", end)
                    end = len(text) if end < 0 else end
                else:
                    end = len(text)
                part = text[at:end]
                if self.lowers(part, small := part.lower()):
                    part = small
                runs = part.replace("\n", " ").replace("\t", " ").split(" ")
                held.append((k, runs, list(map(self.get, runs))))
                size += end - at
                at = end
                if size >= HELD_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; vocabulary: a tokenizer file that every worker can read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            coded = e.ids([t or "" for t in batch.column(1).to_pylist()])
            rows = []
            for doc, ids, h in zip(batch.column(0).to_pylist(), coded, batch.column(2).to_pylist()):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int32(), *[pa.int64()] * 4))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_h"],
            )

    hashed = F.xxhash64(F.col(id_col), F.length(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), hashed.alias("_h")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of lengths, longest piece first; every length is used as often as it occurs."""
    left = Counter(int(x) for x in lengths)
    there = 0  # bit x: a piece of length x is left
    for x in left:
        there |= 1 << x

    def longest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(x: int) -> None:
        nonlocal there
        left[x] -= 1
        if not left[x]:
            there &= ~(1 << x)

    def give(x: int) -> None:
        nonlocal there
        left[x] += 1
        there |= 1 << x

    def two_for(gap: int) -> tuple[int, int]:
        """Two pieces that fill the gap as far as any two can."""
        best, pair = 0, (0, 0)
        a = longest(gap - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(a, gap - a))
            if b == a and left[a] < 2:
                b = longest(min(a - 1, gap - a))
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
            a = longest(a - 1)
        return pair

    out = []
    while there:
        row, gap = [], capacity
        while (x := longest(gap)) > 0:
            take(x)
            row.append(x)
            gap -= x
        if gap and len(row) > 1:
            a, b = two_for(gap + row[-1])
            if a + b > row[-1]:
                give(row.pop())
                take(a)
                take(b)
                row += [a, b]
        out.append(row)
    return out


def pack(found: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (with ``_h``, a hash by which they are dealt to groups)."""

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "_h", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = g["length"].to_numpy()
        ends = np.searchsorted(lengths, np.arange(capacity + 2))  # pieces of length x stand at ends[x]..ends[x + 1]
        at = ends[:-1].copy()
        sequence, offset = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for k, row in enumerate(best_two_fit(lengths, capacity)):
            place = 0
            for x in row:
                i = at[x]
                at[x] += 1
                sequence[i], offset[i] = k, place
                place += x
        g["sequence_id"] = (int(g["_g"].iloc[0]) << 40) + sequence
        g["offset"] = offset
        return g[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.withColumn("_g", F.pmod(F.col("_h"), F.lit(groups))).groupBy("_g").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   group: int = GROUP) -> DataFrame:
    groups = max(1, -(-docs.count() // group))
    return pack(pieces(docs, vocabulary, id_col, text_col, capacity), groups, capacity)
