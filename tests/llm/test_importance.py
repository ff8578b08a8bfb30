import math
from collections import Counter

import numpy as np

from hydrolake.llm import importance

SF = "/root/testdata/sf0.01"


def grams_of(text):
    b = (text or "").encode()
    return Counter(b[i : i + importance.N] for i in range(len(b) - importance.N + 1))


def bucket(gram):
    found, _ = importance.grams(np.frombuffer(gram, np.uint8), np.array([0, len(gram)]))
    return int(found[0])


def test_log_weights_by_hand(spark, awkward, awkward_rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 40)] + [(1, 0, None), (None, 1, 0), (41, None, 1)], "doc_id long, quality int, toxic int")
    good = {i for i in range(0, 40) if i % 2 and i != 1}
    raw, target, of = Counter(), Counter(), {}
    for doc, text, *_ in awkward_rows:
        for g, n in grams_of(text).items():
            k = of.setdefault(g, bucket(g))
            raw[k] += n
            if doc in good:
                target[k] += n
    total_raw, total_target = sum(raw.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
    rows = importance.resample(awkward, labels).collect()
    assert len(rows) == len(awkward_rows)
    for r in rows:
        grams = grams_of(r["text"])
        want = sum(n * (math.log((target[of[g]] + 1) / total_target) - math.log((raw[of[g]] + 1) / total_raw)) for g, n in grams.items())
        assert r["n_grams"] == sum(grams.values()) and abs(r["log_weight"] - want) < 1e-6 * max(1, abs(want))
        assert 0 <= r["score"] <= 1 and r["lang_pred"] == "own lang_pred"
    k = math.ceil((1 - importance.REJECT * 21 / 40) * len(rows))
    order = sorted(rows, key=lambda r: (-r["sample_key"], r["doc_id"] is not None, r["doc_id"] or 0))
    edge = (-order[k - 1]["sample_key"], order[k - 1]["doc_id"])
    for r in rows:
        assert r["kept"] == ((-r["sample_key"], r["doc_id"] or 0) <= (edge[0], edge[1] or 0))


def test_kth_key_is_exact_through_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    monkeypatch.setattr(importance, "RANGES", 4)
    values = [(float(v), i if i % 7 else None) for i, v in enumerate(np.random.default_rng(0).integers(0, 30, 400))] + [(1e300, 1), (-1e300, 2)]
    df = spark.createDataFrame(values, "key double, id long")
    order = sorted(values, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
    for k in (1, 5, 57, 200, 401):
        assert importance.kth_key(df, k) == order[k - 1]
    assert importance.kth_key(df, 402) is None


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = importance.resample(docs, labels).join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_without_labels_everything_stays(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["kept"], r["log_weight"]) for r in importance.resample(awkward, none).collect()} == {(True, 0.0)}
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert importance.resample(nothing, some).count() == 0
