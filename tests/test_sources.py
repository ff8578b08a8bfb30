import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hydrolake.operators.ranking import preview
from hydrolake.sources import files, logs


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-02", 3.5)], "loc int, tanggal string, rain double")
    files.write_table(df, str(tmp_path / "c"), "csv")
    back = files.read_csv(spark, str(tmp_path / "c"), "loc int, tanggal string, rain double", {"tanggal": "yyyy-MM-dd"})
    assert tuple(back.first()) == (1, dt.date(2024, 1, 2), 3.5)


def test_parquet_keeps_only_existing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, "n", 9)], "id int, lon double, lat double, name string, other int")
    files.write_table(df, str(tmp_path / "b"))
    back = files.read_buildings(spark, str(tmp_path / "b"))
    assert back.columns == ["id", "lon", "lat", "name"]
    assert "other" not in back._jdf.queryExecution().executedPlan().toString()


def test_json_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"latitude": 1, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [0.5, None], "wind_speed_10m": [3.0]}}))
    raw = files.read_responses(spark, str(tmp_path))
    out = files.json_arrays_to_rows(raw, "hourly", {"precipitation": "rain", "wind_speed_10m": "wind", "absent": "x"}).orderBy("time").collect()
    assert [(r.time, r.rain, r.wind, r.x) for r in out] == [(dt.datetime(2024, 1, 1), 0.5, 3.0, None), (dt.datetime(2024, 1, 1, 1), None, None, None)]


def test_values_on_a_step_axis(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 3600, [1.0, 2.0])], "loc int, start timestamp_ntz, step_seconds int, v array<double>")
    out = files.attach_values(df, "v", "rain").orderBy("time").collect()
    assert [(r.time, r.rain) for r in out] == [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 1, 1), 2.0)]


def test_geojson_types_and_round_trip(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAMOBJ": "A", "mean_elev": 1.5, "risk_pct": 40}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"NAMOBJ": "B", "mean_elev": 2.5, "risk_pct": 10}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [[[9, 9], [8, 8], [7, 9], [9, 9]]]]}},
        {"type": "Feature", "properties": {"NAMOBJ": "C"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc, indent=1))
    zones = {r.NAMOBJ: r for r in files.read_geojson(spark, str(tmp_path / "z.geojson")).collect()}
    assert [tuple(p) for p in zones["A"].ring] == [tuple(map(float, p)) for p in ring]
    assert zones["B"].ring == zones["A"].ring and zones["B"].mean_elev == 2.5 and zones["C"].ring is None
    df = files.read_geojson(spark, str(tmp_path / "z.geojson")).where("ring is not null").withColumn("p10_elev", F.lit(0.5))
    files.write_geojson(df, str(tmp_path / "out"), ["NAMOBJ", "mean_elev", "p10_elev"])
    back = files.geojson_features(spark.read.text(str(tmp_path / "out")), {"NAMOBJ": "string", "p10_elev": "double"})
    assert {(r.NAMOBJ, r.p10_elev, len(r.ring)) for r in back.collect()} == {("A", 0.5, 4), ("B", 0.5, 4)}


def test_history_log_with_ragged_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text(
        "Waktu,Status,Probabilitas,Hujan Hari Ini,Akumulasi 3 Hari\n"
        "2025-12-03 14:54:44,AMAN,22.2%,15.5,23.299999999999997\n"
        "2025-12-08 10:15:10,Aman,12.5,1.30\n"
        "2025-12-08 14:47:45,Banjir,x%,abc,27.7\n")
    out = logs.clean_prediction_log(logs.read_history(spark, str(tmp_path / "h.csv"))).orderBy("waktu").collect()
    assert [(r.status, r.probabilitas, r.hujan_hari_ini, r.akumulasi_3_hari, r.ragged) for r in out] == [
        ("AMAN", pytest.approx(0.222), 15.5, pytest.approx(23.3), False), ("AMAN", None, 12.5, 1.3, True), ("BANJIR", None, None, 27.7, False)]


def test_log_append_partitions_by_day(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 20.5, 1.0), (dt.datetime(2024, 1, 2, 5), 21.5, 0.0)], "timestamp timestamp_ntz, temperature_2m double, precipitation double")
    path = str(tmp_path / "w")
    logs.append_weather(df, path)
    logs.append_weather(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("id").distinct().count() == 4
    assert {r.source for r in back.collect()} == {"open-meteo"} and back.where("humidity is not null").count() == 0
    plan = back.where(F.col("log_date") == F.lit(dt.date(2024, 1, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_prediction_log_schema(spark, tmp_path):
    df = spark.createDataFrame([(7, dt.datetime(2024, 1, 1), -0.5, 117.1, 3.0, 2.0, 0.4, "AMAN")], "k long, timestamp timestamp_ntz, latitude double, longitude double, rain_24h double, tide_level double, probability double, risk_level string")
    logs.append_predictions(df, str(tmp_path / "p"), key="k")
    r = spark.read.parquet(str(tmp_path / "p")).first()
    assert (r.id, r.risk_level, r.actual_outcome) == (7, "AMAN", None)


def test_model_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"features": ["b", "a"], "metrics": {"mae": 2.4, "r2": 0.8}, "model_type": "x"}, indent=2))
    assert files.feature_list(spark, str(tmp_path / "m.json")) == ["b", "a"]
    assert {r.name: r.value for r in files.read_model_meta(spark, str(tmp_path / "m.json"))[1].collect()} == {"mae": 2.4, "r2": 0.8}


def test_run_tracking(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "metric", "auc", 0.9), ("r1", "param", "n", 5.0), ("r2", "metric", "auc", 0.95)], "run string, kind string, name string, value double")
    files.log_run(rows, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert files.best_run(back, "auc").first().run == "r2"
    assert {r.run: (r.auc, r.n) for r in files.pivot_runs(back, ["auc", "n"]).collect()} == {"r1": (0.9, 5.0), "r2": (0.95, None)}


def test_preview_is_stable(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    assert [r.k for r in preview(df, "k", 5).collect()] == [r.k for r in preview(df.repartition(9), "k", 5).collect()]
