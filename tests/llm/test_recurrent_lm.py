import math
import zlib
from collections import Counter

import numpy as np

from hydrolake.llm import recurrent_lm as lm

from .conftest import words_of

SF = "/root/testdata/sf0.01"


def params(seed=0, kind=np.float64):
    rng = np.random.default_rng(seed)
    shapes = {"E": (lm.SYMBOLS, 3 * lm.HIDDEN), "U": (lm.HIDDEN, 3 * lm.HIDDEN), "C": (lm.HIDDEN, lm.CLASSES), "c": (lm.CLASSES,), "M": (lm.HIDDEN, lm.KNOWN + 1), "m": (lm.KNOWN + 1,)}
    return {k: rng.normal(0, 0.4, s).astype(kind) for k, s in shapes.items()}


def test_symbols_of_a_state_sum_to_one():
    p, h = params(), np.random.default_rng(1).normal(size=(1, lm.HIDDEN))
    lp, _, _ = lm.outputs(p, np.repeat(h, lm.SYMBOLS, axis=0), np.arange(lm.SYMBOLS))
    assert abs(np.exp(lp).sum() - 1) < 1e-9


def test_gradient_against_differences():
    p, rng = params(), np.random.default_rng(2)
    x, y = rng.integers(0, lm.SYMBOLS, (2, 4, 3))
    go, h = np.ones((4, 3)), rng.normal(size=(3, lm.HIDDEN))
    go[2, 1] = go[0, 0] = 0
    _, grad, _ = lm.window_gradient(p, h, x, y, go)
    for name in lm.NAMES:
        flat = p[name].reshape(-1)
        where = np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-4)[:: max(1, (np.abs(grad[name]) > 1e-4).sum() // 6)]
        for i in where:
            old = flat[i]
            loss = []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                loss.append(-lm.window_gradient(p, h, x, y, go)[2])
            flat[i] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[name].reshape(-1)[i]) < 1e-4


def test_lanes_score_like_one_text_after_another(monkeypatch):
    monkeypatch.setattr(lm, "SCORE_LANES", 3)
    p, rng = params(kind=np.float32), np.random.default_rng(3)
    sizes = [1, 40, 7, 1, 90, 12, 33, 2]
    symbols = rng.integers(0, lm.SYMBOLS, sum(sizes))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    got = lm.score_chunk(p, symbols, offs)
    for k in range(len(sizes)):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), lm.KNOWN, 0.0
        for s in symbols[offs[k] : offs[k + 1]]:
            h = lm.step(p, h, np.array([last]))[0]
            total += float(lm.outputs(p, h, np.array([s]))[0][0])
            last = s
        assert abs(got[k] - total / math.log(10)) < 1e-3


def check(df, texts, held):
    """Counts and base scores by hand; texts and held: of each row, in order of doc_id."""
    words = [[*words_of(t), "\n"] for t in texts]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = lm.score(df).collect()
    want = sorted((h, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for w, h in zip(words, held))
    got = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-4
    assert {r["train_tokens"] for r in rows} == {total}
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-6 for r in rows)
    return rows


def test_counts_by_hand_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = check(docs, [r["text"] for r in rows], [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.15 * sum(r["n_tokens"] for r in held)


def test_awkward_rows_and_rare_words_by_join(awkward, awkward_rows, nothing, monkeypatch):
    held = [a is not None and zlib.crc32(str(a).encode()) % 5 == 1 for a, *_ in awkward_rows]
    texts = [b for _, b, *_ in awkward_rows]
    whole = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 4)) for r in check(awkward, texts, held))
    assert lm.score(nothing).count() == 0
    monkeypatch.setattr(lm, "FREQUENT", 600)  # most words go by the join
    joined = sorted((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 4)) for r in check(awkward, texts, held))
    assert len(joined) == len(whole)


def test_without_training_documents(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in rows] == [(3, 0, 0, 0.0)]
