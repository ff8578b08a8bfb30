"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Words are counted over all training documents. The KNOWN most frequent words and the end of a text are symbols of their
own, in classes of MEMBERS by frequency; every other word is one of a few rare classes, told by its last byte, digits and
letters beyond ASCII. A word's probability is that of its class given the state, times that of the member given state
and class, or, for a rare class, (count + 0.5) / (class total + 0.5 * (class distinct + 1)), as in the unigram base.

Training goes once over all training documents, in rounds; in each, every task trains from the same parameters on its
own documents, and the results are averaged by tokens. Gradients run back WINDOW steps, the state is carried on from
window to window. Scoring walks each whole document from an empty state; documents run side by side in lanes.

Broadcast are the parameters and the counts of at most FREQUENT words, each of fixed bounded size; the counts of all
other words are joined.

Defined cases: null text is empty and consists of its end alone; a null id counts as training; repeated rows are counted
and scored each; without training documents counts are 0 and the parameters stay at their start; an empty table gives
an empty result; extra columns are dropped. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import blocks_of, flat, fold, per_text, stored, word_hashes

HELD_OUT = 1
KNOWN = 511
MEMBERS = 32
HIDDEN = 16
FREQUENT = 1 << 18
RARE = 9
WINDOW = 20
TRAIN_LANES = 192
SCORE_LANES = 512
#: Tokens that a task holds at once.
CHUNK = 2_000_000
#: Shares of the training documents in each round, in 64ths, and the step sizes.
ROUNDS = ((2, 0.01), (12, 0.006), (50, 0.003))


def rare_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0..8: digits, or last byte a word byte, full stop, comma or other, each with or without letters beyond ASCII."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = np.full(256, 3, np.int64)
    kind[97:123] = kind[65:91] = kind[128:] = 0
    kind[ord(".")], kind[ord(",")] = 1, 2
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    out = kind[data[ends - 1]] + 4 * (wide[ends] > wide[starts])
    return np.where(digit[ends] > digit[starts], 8, out)


# ---- corpus counts ---------------------------------------------------------------------------------


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, class, n over all rows; a task's counts are merged before the shuffle."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, cls, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        word, cls, n = word[order], cls[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return word[first], cls[first], np.add.reduceat(n, first) if len(word) else n

    def batch_of(word: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(cls, pa.int32()), pa.array(n)], names=["word", "class", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offs = flat(batch.column(0))
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                raw = data[part[0] : part[-1]]
                hashes, _, starts, ends = word_hashes(raw, part - part[0])
                word, at, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((word, rare_class(raw, starts[at], ends[at]), n.astype(np.int64)))
                size += len(word)
                if size > 1_500_000:
                    one = merged(parts)
                    if len(one[0]) > 700_000:
                        yield batch_of(*one)
                        parts, size = [], 0
                    else:
                        parts, size = [one], len(one[0])
        if parts:
            yield batch_of(*merged(parts))

    rows = docs.select(F.col(text_col)).mapInArrow(count, "word long, class int, n long")
    return rows.groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    symbols: np.ndarray  # of the frequent words; known ones below KNOWN, else KNOWN + 1 + rare class
    start: np.ndarray  # for the leading bits of a hash, the first word
    shift: int
    total: int
    distinct: int
    ends: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    known_counts: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the frequent words, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.words):
            return out
        lead = (hashes >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        rest = np.arange(len(hashes))
        at = at.astype(np.int64)
        while len(rest):
            open_ = at < end
            rest, at, end = rest[open_], at[open_], end[open_]
            same = self.words[at] == hashes[rest]
            out[rest[same]] = at[same]
            more = ~same
            rest, at, end = rest[more], at[more] + 1, end[more]
        return out

    @property
    def base_total(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def rare_total(self) -> np.ndarray:
        return self.class_total + 0.5 * (self.class_distinct + 1)


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count at which at most FREQUENT words are left
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    from pyspark.sql import Window

    above = by_count.withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = above.where(F.col("above") <= FREQUENT).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas().sort_values("word")
    words, n, cls = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), rows["class"].to_numpy(np.int64)
    order = np.argsort(words)
    words, n, cls = words[order], n[order], cls[order]
    known = np.lexsort((words, -n))[:KNOWN]
    symbols = KNOWN + 1 + cls
    symbols[known] = np.arange(len(known))
    class_total, class_distinct = np.zeros(RARE), np.zeros(RARE)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        class_total[r["class"]], class_distinct[r["class"]] = r["n"], r["m"]
    np.subtract.at(class_total, cls[known], n[known])
    np.subtract.at(class_distinct, cls[known], 1)
    bits = max(1, int(np.ceil(np.log2(max(2, len(words))))))
    start = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return Vocabulary(words, n, symbols.astype(np.int16), np.append(start, len(words)).astype(np.int32), 64 - bits, int(total) + n_docs,
                      int(distinct) + (n_docs > 0), n_docs, class_total, class_distinct, np.concatenate([n[known], np.zeros(KNOWN - len(known), np.int64)]))


CODED = ("doc_id long, held_out boolean, n_tokens long, known long, base double, rare double, others array<long>, symbols binary")


def coded(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's symbols, what its frequent words add to the scores, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_count = np.append(np.log10(v.counts + 0.5), 0.0)
        symbol_of = np.append(v.symbols, 0).astype(np.int64)
        log_class = np.log10(v.rare_total)
        end_base = np.log10(v.ends + 0.5)
        for batch in batches:
            data, offs = flat(batch.column(2))
            for a, b in blocks_of(offs):
                part = offs[a : b + 1]
                raw = data[part[0] : part[-1]]
                hashes, first, starts, ends = word_hashes(raw, part - part[0])
                found = v.look_up(hashes)
                other = found < 0
                symbol = symbol_of[found]
                symbol[other] = KNOWN + 1 + rare_class(raw, starts[other], ends[other])
                n_words = np.diff(first)
                base = per_text(log_count[found], first) + end_base - (n_words + 1) * np.log10(v.base_total)
                is_rare = symbol > KNOWN
                rare = per_text(np.where(is_rare, log_count[found] - log_class[np.maximum(symbol - KNOWN - 1, 0)], 0.0), first)
                known = per_text((~other).astype(np.int64), first) + (v.ends > 0)
                # symbols of each text with its end
                m = b - a
                out = np.full(len(symbol) + m, KNOWN, np.int16)
                place = np.arange(len(symbol)) + np.repeat(np.arange(m), n_words)
                out[place] = symbol
                borders = (first + np.arange(m + 1)).astype(np.int64) * 2
                binary = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(borders), pa.py_buffer(out)]).cast(pa.binary())
                others = pa.ListArray.from_arrays(pa.array(per_offsets(other, first), pa.int32()), pa.array(hashes[other].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array(n_words + 1), pa.array(known), pa.array(base), pa.array(rare), others, binary],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "rare", "others", "symbols"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(code, CODED).withColumn("rid", F.monotonically_increasing_id())


def per_offsets(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])[first]


# ---- the network -----------------------------------------------------------------------------------

SYMBOLS = KNOWN + 1 + RARE
GROUPS = (KNOWN + 1) // MEMBERS
CLASSES = GROUPS + RARE
CLASS_OF = np.concatenate([np.arange(KNOWN + 1) // MEMBERS, GROUPS + np.arange(RARE)])
NAMES = ("E", "U", "C", "c", "M", "m")
Params = dict[str, np.ndarray]


def initial(vocab: Vocabulary) -> Params:
    """Small random weights; the biases start at the training counts, so the untrained model is a unigram model."""
    rng = np.random.default_rng(1)
    members = np.append(vocab.known_counts, vocab.ends) + 0.5
    classes = np.concatenate([members.reshape(GROUPS, MEMBERS).sum(axis=1), vocab.class_total + 0.5])
    within = np.log(members / np.repeat(members.reshape(GROUPS, MEMBERS).sum(axis=1), MEMBERS))
    f = lambda x: x.astype(np.float32)
    return {
        "E": f(rng.normal(0, 0.3, (SYMBOLS, 3 * HIDDEN))), "U": f(rng.normal(0, 0.6 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))),
        "C": f(rng.normal(0, 0.05, (HIDDEN, CLASSES))), "c": f(np.log(classes / classes.sum())),
        "M": f(rng.normal(0, 0.05, (HIDDEN, KNOWN + 1))), "m": f(within),
    }


def dumped(p: Params) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in NAMES)


def loaded(raw: bytes, like: Params) -> Params:
    flat_, out, at = np.frombuffer(raw, "<f4"), {}, 0
    for k in NAMES:
        out[k] = flat_[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(p: Params, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Next state from state and input symbols, with what the gradient needs."""
    a, u = p["E"][x], h @ p["U"]
    zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), z, r, n, u[:, 2 * HIDDEN :]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def outputs(p: Params, h: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, Params]:
    """Natural log probability of each target; with weights also the gradient by the states and output parameters."""
    cls = CLASS_OF[y]
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    h, y, cls = h[order], y[order], cls[order]
    rows = np.arange(len(y))
    lp = _log_softmax(h @ p["C"] + p["c"])
    score = lp[rows, cls].copy()
    grad: Params = {}
    dh = None
    if weight is not None:
        w = weight[order][:, None]
        d = np.exp(lp)
        d[rows, cls] -= 1
        d *= w
        grad = {"C": h.T @ d, "c": d.sum(axis=0), "M": np.zeros_like(p["M"]), "m": np.zeros_like(p["m"])}
        dh = d @ p["C"].T
    bounds = np.searchsorted(cls, np.arange(GROUPS + 1))
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if a == b:
            continue
        cols = slice(g * MEMBERS, (g + 1) * MEMBERS)
        lm = _log_softmax(h[a:b] @ p["M"][:, cols] + p["m"][cols])
        at, which = np.arange(b - a), y[a:b] - g * MEMBERS
        score[a:b] += lm[at, which]
        if weight is not None:
            d = np.exp(lm)
            d[at, which] -= 1
            d *= w[a:b]
            grad["M"][:, cols] = h[a:b].T @ d
            grad["m"][cols] = d.sum(axis=0)
            dh[a:b] += d @ p["M"][:, cols].T
    out = np.empty_like(score)
    out[order] = score
    if dh is not None:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return out, dh, grad


def window_gradient(p: Params, h: np.ndarray, x: np.ndarray, y: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, Params, float]:
    """Over a window (steps x lanes) from the carried states; go is 0 where a text begins. State, mean gradient, loss."""
    steps, lanes = x.shape
    kept, states = [], []
    for t in range(steps):
        before = h * go[t][:, None]
        h, *rest = step(p, before, x[t])
        kept.append((before, *rest))
        states.append(h)
    weight = np.full(steps * lanes, 1 / (steps * lanes), np.float32)
    lp, dh_out, grad = outputs(p, np.concatenate(states), y.ravel(), weight)
    dh_out = dh_out.reshape(steps, lanes, HIDDEN)
    da = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    du = np.zeros_like(p["U"])
    dh = np.zeros((lanes, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        before, z, r, n, un = kept[t]
        dh = dh + dh_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        da[t, :, :HIDDEN], da[t, :, HIDDEN : 2 * HIDDEN], da[t, :, 2 * HIDDEN :] = dz, dr, dn
        d_u = np.concatenate([dz, dr, dn * r], axis=1)
        du += before.T @ d_u
        dh = (dh * z + d_u @ p["U"].T) * go[t][:, None]
    flat_x = x.ravel()
    order = np.argsort(flat_x.astype(np.uint16), kind="stable")
    there, first = np.unique(flat_x[order], return_index=True)
    grad["E"] = np.zeros_like(p["E"])
    grad["E"][there] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    grad["U"] = du
    return h, grad, float(lp.mean())


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.a, self.b = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def apply(self, grad: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grad.items():
            g = g * scale
            self.a[k] += np.float32(0.1) * (g - self.a[k])
            self.b[k] += np.float32(0.001) * (g * g - self.b[k])
            self.p[k] -= rate * self.a[k] / (np.sqrt(self.b[k]) + np.float32(1e-7))


def train_chunk(p: Params, adam: Adam, symbols: np.ndarray, begins: np.ndarray) -> None:
    """One pass over a run of texts, cut into lanes; a lane goes on where the one before it ends."""
    lanes = max(1, min(TRAIN_LANES, len(symbols) // WINDOW))
    size = len(symbols) // lanes
    x = np.concatenate([[KNOWN], symbols[:-1]])
    go = np.ones(len(symbols), np.float32)
    go[begins] = 0
    x[begins] = KNOWN
    rest = len(symbols) - size * lanes
    x, y, go = (np.ascontiguousarray(v[: len(v) - rest].reshape(lanes, size).T) for v in (x, symbols, go))
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(0, size, WINDOW):
        h, grad, _ = window_gradient(p, h, x[t : t + WINDOW], y[t : t + WINDOW], go[t : t + WINDOW])
        adam.apply(grad)


def score_chunk(p: Params, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """log10 probability of each text; texts share lanes, the state begins empty with each."""
    sizes = np.diff(offs)
    order = np.argsort(-sizes, kind="stable")
    lanes = min(SCORE_LANES, len(sizes))
    load, lane_of = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in order.tolist():
        n, k = heapq.heappop(load)
        lane_of[k].append(d)
        heapq.heappush(load, (n + int(sizes[d]), k))
    lane_of.sort(key=lambda docs: -sum(int(sizes[d]) for d in docs))
    docs = np.array([d for lane in lane_of for d in lane])
    lane_size = np.array([sum(int(sizes[d]) for d in lane) for lane in lane_of])
    begin = np.cumsum(sizes[docs]) - sizes[docs]
    take = np.repeat(offs[:-1][docs] - begin, sizes[docs]) + np.arange(int(sizes.sum()))
    y = symbols[take].astype(np.int64)
    x = np.concatenate([[KNOWN], y[:-1]])
    x[begin] = KNOWN
    go = np.ones(len(y), np.float32)
    go[begin] = 0
    start = np.cumsum(lane_size) - lane_size
    score = np.empty(len(y))
    h = np.zeros((lanes, HIDDEN), np.float32)
    t = 0
    while t < lane_size[0]:
        steps, states, places = 0, [], []
        n_tokens = 0
        while t < lane_size[0] and (steps == 0 or n_tokens < 16_384):
            n = int(np.searchsorted(-lane_size, -t, side="left"))  # lanes longer than t
            at = start[:n] + t
            h = h[:n]
            h = step(p, h * go[at][:, None], x[at])[0]
            states.append(h)
            places.append(at)
            n_tokens += n
            steps += 1
            t += 1
        at = np.concatenate(places)
        score[at] = outputs(p, np.concatenate(states), y[at])[0]
    owner = np.repeat(docs, sizes[docs])
    return np.bincount(owner, weights=score, minlength=len(sizes)) / np.log(10)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches together with their symbols, about CHUNK tokens at a time."""
    held, size = [], 0

    def out():
        raw = [s for batch in held for s in batch.column(column).to_pylist()]
        offs = np.concatenate([[0], np.cumsum([len(s) // 2 for s in raw])]).astype(np.int64)
        return held, np.frombuffer(b"".join(raw), "<i2"), offs

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def trained(rows: DataFrame, start: Params) -> Params:
    """All rounds; rows: coded training rows with ``part``, 0..63."""
    p, low = start, 0
    for share, rate in ROUNDS:
        shared = rows.sparkSession.sparkContext.broadcast(p)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own = {k: v.copy() for k, v in shared.value.items()}
            adam, n = Adam(own, rate), 0
            for _, symbols, offs in _chunks(batches, 0):
                train_chunk(own, adam, symbols.astype(np.int64), offs[:-1])
                n += len(symbols)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([dumped(own)], pa.binary())], names=["n", "p"])

        def mean(g: pd.DataFrame) -> pd.DataFrame:
            total = np.average(np.stack([np.frombuffer(x, "<f4") for x in g["p"]]), axis=0, weights=g["n"])
            return pd.DataFrame({"n": [int(g["n"].sum())], "p": [total.astype("<f4").tobytes()]})

        part = rows.where((F.col("part") >= low) & (F.col("part") < low + share)).select("symbols")
        low += share
        found = part.mapInArrow(train, "n long, p binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))
        # 16 means of fixed size reach the driver
        means = found.groupBy("g").applyInPandas(mean, "n long, p binary").collect()
        shared.unpersist()
        if means:
            p = loaded(mean(pd.DataFrame({"n": [r["n"] for r in means], "p": [r["p"] for r in means]}))["p"][0], p)
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    training = docs.where(fold(id_col) != HELD_OUT)
    counts = stored(counted(training, text_col))
    vocab = vocabulary(counts, training.count())
    rows = stored(coded(docs, vocab, id_col, text_col))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("round")), F.lit(64))
    p = trained(rows.where(~F.col("held_out")).select("symbols", part.alias("part")), initial(vocab))
    shared = docs.sparkSession.sparkContext.broadcast(p)
    columns = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "rare"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, symbols, offs in _chunks(batches, len(columns)):
            found, at = score_chunk(shared.value, symbols, offs), 0
            for batch in held:
                own = found[at : at + batch.num_rows]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(own)], names=[*columns, "lm"])

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare double, lm double"
    walked = rows.select(*columns, "symbols").mapInArrow(walk, schema)
    other = (
        rows.select("rid", F.explode("others").alias("word")).join(counts.select("word", "n"), "word", "left")
        .groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("more"))
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return walked.join(other, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("lm") + F.col("rare") + logs).alias("score"),
    )
