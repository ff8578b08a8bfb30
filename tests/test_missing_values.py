"""Nothing falls out: missing labels, keys, dates and values, ties, empty tables, unlimited look-back."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hydrolake.operators import metrics, neighbours, ranking, series, stats, timegrid
from hydrolake.streaming import jobs


def test_recursive_index_keeps_all_rain_at_any_size(spark):
    x = [1e30] + [1.0] * 299 + [0.0] * 4000 + [5.0]
    want, a = [], 0.0
    for v in x:
        a = a * 0.85 + v
        want.append(a)
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], f"loc long, {series.INDEX} long, rain double").withColumn("i", F.col(series.INDEX))
    for size in (1, 7, 128, series.ROWS_PER_CHUNK):
        got = [r["api"] for r in series.recursive_index(df, "rain", 0.85, size=size).orderBy("i").collect()]
        assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want)), size


def test_alerts_come_again_after_the_cooldown(spark, tmp_path):
    schema = "loc long, status string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    for hour in (0, 2, 7, 9, 11, 13, 20):
        row = [(1, "AWAS", start + dt.timedelta(hours=hour)), (1, "AMAN", start + dt.timedelta(hours=hour))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["status"], (r["ts"] - start).total_seconds() / 3600) for r in got] == [("AWAS", h) for h in (0, 7, 13, 20)]
    # all in one batch
    one = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.start_alerts(one, str(tmp_path / "out1"), str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out1")).count() == 4


def test_rows_without_label_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, None)], "id long, y string")
    assert ranking.stratified_split(df, "y", "id").count() == 5
    assert sorted(r["fold"] for r in ranking.kfold_assign(df, "y", "id", 3).where("y is null").collect()) == [0, 1, 2]
    assert {r["y"]: r["count"] for r in ranking.upsample(df, "y", "id").groupBy("y").count().collect()} == {"a": 3, None: 3}
    codes = {r["y"]: r["encoded"] for r in ranking.label_encode(df.unionByName(spark.createDataFrame([(6, "B")], df.schema)), "y").collect()}
    assert codes == {"B": 0, "a": 1, None: None}


def test_rows_without_date_are_numbered_first(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (1, None), (1, dt.date(2024, 3, 1))], "loc long, d date")
    got = {r["d"]: r[series.INDEX] for r in series.row_index(df, "d", "loc").collect()}
    assert got == {None: 0, dt.date(2024, 1, 2): 1, dt.date(2024, 3, 1): 2}


def test_statistics_keep_missing_groups_and_measures(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), (1, 5.0, None), (1, None, None)], "g long, a double, b double")
    rows = {(r["g"], r["measure"]): r["median"] for r in stats.describe(df, ["a", "b"], ["g"]).collect()}
    assert rows == {(None, "a"): 2.0, (None, "b"): None, (1, "a"): 5.0, (1, "b"): None}
    bins = stats.quartile_bins(df, "a", ["g"]).collect()
    assert len(bins) == 4 and {r["kategori"] for r in bins if r["a"] is None} == {None}
    assert all(r["kategori"] is not None for r in bins if r["a"] is not None)


def test_scores_empty_or_infinite(spark):
    schema = "y int, s double"
    assert metrics.roc_auc(spark.createDataFrame([], schema), "y", "s").first()["auc"] is None
    rows = [(1, math.inf), (0, -math.inf), (1, 0.5), (0, 0.2), (0, math.inf)]
    assert metrics.roc_auc(spark.createDataFrame(rows, schema), "y", "s").first()["auc"] == pytest.approx((2 + 0.5 + 2) / 6)
    only = [(1, math.inf), (0, -math.inf)]
    assert metrics.roc_auc(spark.createDataFrame(only, schema), "y", "s").first()["auc"] == 1.0


def test_newest_row_of_equal_times_is_fixed(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, v) for v in (3, 9, 4)], "loc long, time timestamp_ntz, v long")
    for parts in (1, 3):
        got = timegrid.latest_before(df.repartition(parts), F.lit(t), "1 hour").collect()
        assert [r["v"] for r in got] == [9]


def test_a_class_of_one_row_is_refused(spark):
    rows = [(i, "a", [float(i), 0.0]) for i in range(4)] + [(9, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, y string, x array<double>")
    with pytest.raises(Exception, match="needs two rows"):
        neighbours.smote(df, 2).collect()


def test_dry_hours_upstream_count_zero(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(hours=h), "purchase", 1.0) for h in range(12)] + [(1, t + dt.timedelta(hours=1), "error", 4.0)]
    batch = jobs.upstream_frame(spark.createDataFrame(rows, "loc long, ts timestamp, kind string, value double"))
    got = {r["window"]["start"].hour: r["upstream_rain"] for r in batch.collect()}
    assert got == {h: 4.0 if h == 7 else 0.0 for h in range(12)}
