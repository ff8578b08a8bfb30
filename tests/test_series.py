import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.operators import rolling, series, timegrid
from hydrolake.operators.series import INDEX, Series


@pytest.fixture(scope="module")
def walk(spark):
    """Three series, one of them holding most rows, with gaps in the values."""
    rng = random.Random(7)
    data = []
    for loc, n in ((1, 400), (2, 37), (3, 1)):
        for i in range(n):
            wet = rng.random() < 0.4
            data.append((loc, i, None if rng.random() < 0.05 else (round(rng.random() * 20, 2) if wet else 0.0)))
    return spark.createDataFrame(data, "loc long, _index long, x double").cache()


def plain():
    return W.partitionBy("loc").orderBy(INDEX)


def same(a, b, columns):
    left = {(r["loc"], r[INDEX]): [r[c] for c in columns] for r in a.collect()}
    right = {(r["loc"], r[INDEX]): [r[c] for c in columns] for r in b.collect()}
    assert left.keys() == right.keys()
    for k in left:
        for u, v in zip(left[k], right[k]):
            assert (u is None and v is None) or u == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize("size", [24, 50, 4096])
@pytest.mark.parametrize("partitions", [1, 7])
def test_chunked_windows_equal_plain_windows(walk, size, partitions):
    s = Series(walk.repartition(partitions), back=23, ahead=2, size=size)
    s.add(
        total=s.rolling("x", 24),
        strict=s.rolling("x", 3, min_rows=3),
        top=s.rolling("x", 5, F.max),
        before=s.lag("x", 7),
        after=s.lead("x", 2),
        change=s.diff("x", 3),
        centre=s.centered_mean("x", 1),
        keep=F.col(INDEX),
    )
    got = s.rows().withColumnRenamed("keep", INDEX)
    w3 = plain().rowsBetween(-2, 0)
    want = walk.withColumns(
        {
            "total": F.sum("x").over(plain().rowsBetween(-23, 0)),
            "strict": F.when(F.count("x").over(w3) >= 3, F.sum("x").over(w3)),
            "top": F.max("x").over(plain().rowsBetween(-4, 0)),
            "before": F.lag("x", 7).over(plain()),
            "after": F.lead("x", 2).over(plain()),
            "change": F.coalesce(F.col("x") - F.lag("x", 3).over(plain()), F.lit(0.0)),
            "centre": F.avg("x").over(plain().rowsBetween(-1, 1)),
        }
    )
    same(got, want, ["total", "strict", "top", "before", "after", "change", "centre"])


def test_stacked_sum_equals_wide_window(walk):
    s = Series(walk, back=167, size=200)
    s.add(day=s.rolling("x", 24), keep=F.col(INDEX))
    s.add(week=s.stacked_sum("day", 24, 7))
    want = walk.withColumn("week", F.sum("x").over(plain().rowsBetween(-167, 0)))
    same(s.rows().withColumnRenamed("keep", INDEX), want, ["week"])


def test_reach_is_checked(walk):
    s = Series(walk, back=5)
    with pytest.raises(ValueError):
        s.rolling("x", 24)
    with pytest.raises(ValueError):
        s.lead("x", 1)
    with pytest.raises(ValueError):
        Series(walk, back=100, size=50)


@pytest.mark.parametrize("size", [5, 64, 4096])
def test_run_length_over_chunks(walk, size):
    flagged = walk.withColumn("keep", F.col(INDEX))
    got = series.run_length(flagged, F.col("x") > 0, "run", size=size)
    expected = {}
    for r in sorted(walk.collect(), key=lambda r: (r["loc"], r[INDEX])):
        prev = expected.get((r["loc"], r[INDEX] - 1), 0)
        expected[(r["loc"], r[INDEX])] = prev + 1 if r["x"] is not None and r["x"] > 0 else 0
    assert {(r["loc"], r["keep"]): r["run"] for r in got.collect()} == expected


def test_run_that_spans_many_chunks(spark):
    df = spark.range(100).select(F.lit(1).alias("loc"), F.col("id").alias(INDEX), F.col("id").alias("i"))
    got = series.run_length(df, F.col("i") >= 10, "run", size=8)
    assert {r.i: r.run for r in got.collect()} == {i: max(0, i - 9) for i in range(100)}


@pytest.mark.parametrize("k,size", [(0.85, 16), (0.85, 4096), (0.99, 32), (0.2, 4096)])
def test_recursive_index_equals_loop(walk, k, size):
    got = series.recursive_index(walk.withColumn("keep", F.col(INDEX)), "x", k, size=size)
    state, expected = {}, {}
    for r in sorted(walk.collect(), key=lambda r: (r["loc"], r[INDEX])):
        state[r["loc"]] = (r["x"] or 0.0) + k * state.get(r["loc"], 0.0)
        expected[(r["loc"], r[INDEX])] = state[r["loc"]]
    for r in got.collect():
        assert r["api"] == pytest.approx(expected[(r["loc"], r["keep"])], rel=1e-11, abs=1e-12)


def test_recursive_index_hand_made(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 0.0, 0.0, 20.0])], f"loc int, {INDEX} long, x double")
    got = series.recursive_index(df.withColumn("i", F.col(INDEX)), "x", 0.85, size=2)
    assert [r.api for r in got.orderBy("i").collect()] == pytest.approx([10, 8.5, 7.225, 26.14125])


def test_row_index_numbers_rows_over_buckets(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("loc"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int), 0)").alias("t")
    )
    got = series.row_index(df.repartition(5), "t").orderBy("loc", "t").collect()
    seen = {}
    for r in got:
        assert r[INDEX] == seen.get(r["loc"], 0)
        seen[r["loc"]] = r[INDEX] + 1


@pytest.mark.parametrize("size", [4, 4096])
def test_backfill_takes_next_known_value(spark, size):
    x = [None, None, None, None, None, None, None, 5.0, 6.0, None, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], f"loc int, {INDEX} long, x double").withColumn("i", F.col(INDEX))
    got = [r.y for r in series.backfill_first(df, "x", "y", size=size).orderBy("i").collect()]
    lagged = [None, *x[:-1]]
    want = [next((v for v in lagged[i:] if v is not None), None) for i in range(len(x))]
    assert got == want


def test_row_lag_differs_from_calendar_lag(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", 6.0), (1, "2024-01-04", 7.0)], "loc int, d string, rain double").withColumn(
        "tanggal", F.to_date("d")
    )
    row = rolling.row_lags(series.row_index(df, "tanggal"), "rain", [1], "lag").orderBy("tanggal").collect()
    cal = timegrid.calendar_lags(df, "rain", 1, "lag").orderBy("tanggal").collect()
    assert [r.lag1 for r in row] == [0, 5, 6]
    assert [r.lag1 for r in cal] == [0, 5, 0]


def test_calendar_lags_cross_span_borders(spark):
    df = spark.range(200).select(F.lit(1).alias("loc"), F.expr("date_add(date'2024-01-01', cast(id as int))").alias("tanggal"), F.col("id").cast("double").alias("v"))
    got = timegrid.calendar_lags(df, "v", 3, "lag", months=1).orderBy("tanggal").collect()
    for i, r in enumerate(got):
        assert [r.lag1, r.lag2, r.lag3] == [max(0, i - k) for k in (1, 2, 3)]


def test_hand_made_windows(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, None, 3.0])], f"loc int, {INDEX} long, x double").withColumn("i", F.col(INDEX))
    assert [r.x_3 for r in rolling.rolling(df, "x", 3).orderBy("i").collect()] == [1, 1, 4]
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 30.0, 60.0])], f"loc int, {INDEX} long, x double").withColumn("i", F.col(INDEX))
    assert [r.x for r in rolling.centered_mean(c, "x").orderBy("i").collect()] == [15, 30, 45]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate([2.0, 2.1, 2.1, 1.9])], f"loc int, {INDEX} long, est double").withColumn("i", F.col(INDEX))
    assert [r.tide_trend for r in rolling.tide_trend(t).orderBy("i").collect()] == ["Surut", "Pasang Naik", "Stabil", "Surut"]


def test_flood_history_leak_switch(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate([2, 0, 1])], f"loc int, {INDEX} long, label int").withColumn("i", F.col(INDEX))
    clean = rolling.flood_history(df).orderBy("i").collect()
    leaky = rolling.flood_history(df, exclude_current=False).orderBy("i").collect()
    assert [(r.prev_flood_30d, r.prev_meluap_30d) for r in clean] == [(0, 0), (1, 1), (1, 1)]
    assert [(r.prev_flood_30d, r.prev_meluap_30d) for r in leaky] == [(1, 1), (1, 1), (1, 2)]
