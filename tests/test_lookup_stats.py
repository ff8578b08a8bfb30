import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.operators import metrics, ranking, stats, timegrid

T0 = dt.datetime(2024, 1, 1)


def test_hour_axis_is_left_closed(spark):
    got = [r.time for r in timegrid.hour_axis(spark, "2024-01-01 00:00:00", "2024-01-01 03:00:00").collect()]
    assert got == [T0 + dt.timedelta(hours=h) for h in range(3)]


def test_gap_fill(spark):
    df = spark.createDataFrame([(1, T0, 5.0, None), (1, T0 + dt.timedelta(hours=3000), 6.0, 1.0), (2, T0 + dt.timedelta(hours=1), 7.0, 2.0)], "loc int, time timestamp_ntz, rain double, note double")
    out = timegrid.gap_fill(df, {"rain": 0.0})
    assert out.count() == 2 * 3001 and out.select("loc", "time").distinct().count() == 2 * 3001
    assert out.agg(F.sum("rain")).first()[0] == 18
    assert out.where("note is not null").count() == 2


def test_nearest_row_tie_is_earlier(spark):
    df = spark.createDataFrame([(1, T0, "a"), (1, T0 + dt.timedelta(hours=2), "b"), (2, T0 + dt.timedelta(hours=5), "c")], "loc int, time timestamp_ntz, v string")
    at = F.lit(T0 + dt.timedelta(hours=1)).cast("timestamp_ntz")
    assert {r["loc"]: r.v for r in timegrid.nearest_row(df, at).collect()} == {1: "a", 2: "c"}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bins", [60, 7200, None])
def test_asof_equals_brute_force(spark, direction, bins):
    rng = random.Random(11)
    left = [(i, 1 if rng.random() < 0.8 else 2, T0 + dt.timedelta(seconds=rng.randrange(200_000))) for i in range(300)]
    right = [(100 + i, 1 if rng.random() < 0.8 else 2, T0 + dt.timedelta(seconds=rng.randrange(0, 200_000, 40))) for i in range(200)]
    l = spark.createDataFrame(left, "id int, loc int, time timestamp_ntz")
    r = spark.createDataFrame(right, "id int, loc int, time timestamp_ntz")
    got = {x.id: x.r_id for x in timegrid.asof_join(l, r, 3600, direction=direction, tie="id", bin_seconds=bins).collect()}
    assert len(got) == 300
    for i, loc, t in left:
        if direction == "backward":
            near = [(u, j) for j, k, u in right if k == loc and u <= t and (t - u).total_seconds() <= 3600]
            want = max(near)[1] if near else None
        else:
            near = [(u, j) for j, k, u in right if k == loc and u >= t and (u - t).total_seconds() <= 3600]
            want = min(near)[1] if near else None
        assert got[i] == want


def test_percentiles_are_exact_for_large_and_small_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"big": rng.normal(size=5000), "ties": rng.integers(0, 4, size=3000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None)], "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in stats.exact_percentiles(df, "v", probs, ["g"]).collect():
        assert r.n == len(groups[r.g])
        assert r.q == pytest.approx(list(np.percentile(groups[r.g], [p * 100 for p in probs])), abs=1e-12)


def test_percentile_hand_made(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert stats.exact_percentiles(df, "v", [0.1]).first().q == pytest.approx([1.3])


def test_completeness(spark):
    df = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(minutes=10)), (1, T0 + dt.timedelta(minutes=10)), (1, T0 + dt.timedelta(minutes=40))], "s int, t timestamp_ntz")
    r = stats.series_completeness(df, "t", "s").first()
    assert (r.expected, r.present, r.missing, r.duplicates) == (5, 3, 2, 1)


def test_impute_and_scale_use_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    other = spark.createDataFrame([(None, 7.0)], "a double, b double")
    assert stats.mean_impute(train, ["a"], other).first().a == 2
    scaled = stats.standardize(train, ["a", "b"], spark.createDataFrame([(4.0, 7.0)], "a double, b double")).first()
    assert scaled.a == pytest.approx(2.0) and scaled.b == pytest.approx(2.0)


@pytest.fixture(scope="module")
def classes(spark):
    """One class holds nine tenths of the rows."""
    return spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 100 == 0, "c").otherwise("b")).otherwise("a").alias("y"))


def test_class_rank_is_a_permutation(classes):
    a = {r.id: (r.y, r._rank, r._n) for r in ranking.class_rank(classes, "y", "id").collect()}
    b = {r.id: (r.y, r._rank, r._n) for r in ranking.class_rank(classes.repartition(13), "y", "id", hex_digits=1).collect()}
    assert a == b
    for y, n in (("a", 2700), ("b", 270), ("c", 30)):
        assert sorted(v[1] for v in a.values() if v[0] == y) == list(range(1, n + 1))
        assert all(v[2] == n for v in a.values() if v[0] == y)


def test_split_and_folds(classes):
    split = {(r.y, r.is_train): r["count"] for r in ranking.stratified_split(classes, "y", "id").groupBy("y", "is_train").count().collect()}
    assert split == {("a", 1): 2160, ("a", 0): 540, ("b", 1): 216, ("b", 0): 54, ("c", 1): 24, ("c", 0): 6}
    folds = ranking.kfold_assign(classes, "y", "id", 10).groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in folds} == {("a", 270), ("b", 27), ("c", 3)}


def test_upsample_reaches_largest_class(classes):
    up = ranking.upsample(classes, "y", "id")
    assert {r.y: r["count"] for r in up.groupBy("y").count().collect()} == {"a": 2700, "b": 2700, "c": 2700}
    assert up.select("id").distinct().count() == 3000


def test_rows_repeat_in_blocks(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2500)], "k int, n int")
    got = ranking.repeat_rows(df, F.col("n"), ["k"], block=100)
    assert {(r.k, r.c, r.lo, r.hi) for r in got.groupBy("k").agg(F.countDistinct("copy").alias("c"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).collect()} == {(2, 1, 1, 1), (3, 2500, 1, 2500)}
    assert got.count() == 2501


def test_dedupe_folds_copies(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")] + [(3, i, "z") for i in range(500)], "k int, o int, v string")
    assert {r.k: (r.o, r.v) for r in ranking.dedupe(df, ["k"], ["o"]).collect()} == {1: (3, "a"), 2: (1, "c"), 3: (0, "z")}


def test_label_encode_and_weights(spark):
    df = spark.createDataFrame([("Banjir",), ("Aman",), ("Aman",), ("Air Meluap",), (None,)], "s string")
    got = {r.s: r.encoded for r in ranking.label_encode(df, "s").collect()}
    assert got == {"Air Meluap": 0, "Aman": 1, "Banjir": 2, None: None}
    weights = {r.s: r.weight for r in ranking.class_weights(df.na.drop(), "s").collect()}
    assert weights == {"Aman": pytest.approx(4 / 6), "Banjir": pytest.approx(4 / 3), "Air Meluap": pytest.approx(4 / 3)}


def test_f1_threshold_hand_made(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    best = metrics.best_threshold(df, "y", "s").first()
    assert best.threshold == 0.7 and best.f1 == pytest.approx(0.8)


def test_prefix_sums_and_auc(spark):
    rng = random.Random(2)
    data = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(data, "s double, y int")
    table = metrics.score_table(df, "y", "s")
    for r in metrics.prefix_sums(table, "score", ["pos", "neg"]).collect():
        assert r.below_pos == sum(y for s, y in data if s < r.score)
        assert r.below_neg == sum(1 - y for s, y in data if s < r.score)
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(want)


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (2, 0)], "y int, p int")
    report = {r["class"]: r for r in metrics.class_report(df, "y", "p").collect()}
    assert report[1].precision == pytest.approx(2 / 3) and report[1].recall == pytest.approx(2 / 3)
    assert report[2].f1 == 0 and report[2].support == 1
    s = metrics.summary(metrics.class_report(df, "y", "p")).first()
    assert s.accuracy == pytest.approx(0.5)
    assert s.f1_macro == pytest.approx(sum(r.f1 for r in report.values()) / 3)


def test_regression_metrics(spark):
    r = metrics.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "y double, p double"), "y", "p").first()
    assert r.mae == pytest.approx(1) and r.rmse == pytest.approx((5 / 3) ** 0.5) and r.r2 == pytest.approx(1 - 5 / 8)


def test_top_contributions_ranks_both_signs(spark):
    df = spark.createDataFrame([(1, 3.0, -4.0, 0.5, 0.0)], "id int, a double, b double, c double, d double")
    got = [(r["rank"], r.feature, r.direction, r.sign_rank) for r in ranking.top_contributions(df, ["id"], ["a", "b", "c", "d"], k=1, signed=2).collect()]
    assert got == [(1, "b", "Decrease Risk", 1), (2, "a", "Increase Risk", 1), (3, "c", "Increase Risk", 2)]


def test_running_sums_and_areas_of_groups(spark):
    rng = random.Random(7)
    edge = [0.0, -0.0, 1e-300, -1e-300, float("inf"), float("-inf"), 5e-324]
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), rng.choice(edge), round(rng.random(), 1)]), int(rng.random() < 0.4)) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, s double, y int")
    table = metrics.score_table(df, "y", "s", ["g"])
    for r in metrics.prefix_sums(table, "score", ["neg"], ["g"]).collect():
        assert r.below_neg == sum(1 - y for g, s, y in data if g == r.g and s < r.score)
    for r in metrics.roc_auc(df, "y", "s", ["g"]).collect():
        pos, neg = [s for g, s, y in data if g == r.g and y], [s for g, s, y in data if g == r.g and not y]
        assert r.auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_nothing_runs_while_a_curve_is_planned(spark):
    df = spark.range(100).select((F.col("id") / 7).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "curves")
    metrics.roc_auc(df, "y", "s")
    metrics.pr_curve(df, "y", "s")
    stats.exact_percentiles(df, "s", [0.5], ["y"])
    assert list(tracker.getJobIdsForGroup("planning")) == []


def test_percentiles_of_hot_null_and_odd_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1e-9), rng.gauss(0, 1e9), 4.0])) for _ in range(5000)] + [(None, float(k)) for k in range(10)]
    rows += [("one", 2.5), ("none", None), ("none", float("nan")), ("same", -1.0), ("same", -1.0), ("far", float("inf")), ("far", float("inf")), ("sign", -0.0), ("sign", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.g: (r.n, r.q) for r in stats.exact_percentiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {"hot", None, "one", "same", "far", "sign"}
    for g, (n, q) in got.items():
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert n == len(own)
        assert q == (own[:1] * len(probs) if g == "far" else pytest.approx(np.quantile(own, probs).tolist(), rel=1e-12, abs=1e-18))
    whole = stats.exact_percentiles(df, "v", [0.5]).collect()
    assert len(whole) == 1 and whole[0].n == 5017


def test_outliers_of_rows_without_a_group(spark):
    rows = [(None, float(k % 3)) for k in range(30)] + [(None, 99.0)]
    got = stats.iqr_outliers(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()
    assert [(r.g, r.v) for r in got] == [(None, 99.0)]


@pytest.mark.parametrize("name", ["threshold_flags", "nearest_row"])
def test_dense_hours_are_never_broadcast(spark, tmp_path, name):
    """The dense side of the join holds every hour of every place; Spark sizes it before its hours are laid out."""
    from hydrolake.catalog import load

    hours = "explode(sequence(timestamp'2024-01-01', timestamp'2024-02-01', interval 7 hours))"
    events = spark.range(40).selectExpr("id * 5 as user_id", f"{hours} as ts").selectExpr("monotonically_increasing_id() as event_id", "ts", "user_id", "'purchase' as event_type", "cast(user_id as double) as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = load()[name](spark, str(tmp_path))
    assert df.count() == (40 if name == "nearest_row" else events.count())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Generate explode" in plan and "BroadcastHashJoin" not in plan
