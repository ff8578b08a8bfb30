import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk, sqlfuncs, text
from hydrolake.operators import alerts
from hydrolake.plans import features, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "depth,label,color",
    [(10, "AMAN", "green"), (19.999, "AMAN", "green"), (20, "WASPADA", "yellow"), (25, "WASPADA", "yellow"), (50, "SIAGA", "orange"),
     (75, "SIAGA", "orange"), (100, "AWAS", "red"), (150, "AWAS", "red")],
)
def test_bands(spark, depth, label, color):
    d = F.lit(float(depth))
    assert one(spark, risk.risk_label(d)) == label
    assert one(spark, risk.risk_color(d)) == color


def test_missing_depth(spark):
    missing = F.lit(None).cast("double")
    assert one(spark, risk.risk_label(missing)) is None
    assert one(spark, risk.risk_label(F.lit(float("nan")))) is None
    assert one(spark, risk.risk_label(missing, nan_as_awas=True)) == "AWAS"
    assert one(spark, risk.risk_label(F.lit(float("nan")), nan_as_awas=True)) == "AWAS"


def test_thresholds_ascend():
    assert 0 < config.DEPTH_WASPADA < config.DEPTH_SIAGA < config.DEPTH_AWAS
    assert (config.DEPTH_WASPADA, config.DEPTH_SIAGA, config.DEPTH_AWAS) == (20, 50, 100)


@pytest.mark.parametrize("depth,rain,tide,part", [(60, 65, 2.0, "Hujan Deras"), (120, 180, 2.0, "Hujan Ekstrem"), (30, 10, 3.5, "Pasang")])
def test_reasons(spark, depth, rain, tide, part):
    assert part in one(spark, risk.reasons(F.lit(float(depth)), F.lit(float(rain)), F.lit(float(tide))))


def test_reasons_without_inputs(spark):
    assert one(spark, risk.reasons(F.lit(5.0))) == "Kondisi Kondusif"
    assert one(spark, risk.reasons(F.lit(15.0))) == "Akumulasi Air Permukaan"


def test_main_factor(spark):
    factor = lambda r, t: one(spark, risk.main_factor(F.lit(float(r)), F.lit(float(t))))
    assert factor(160, 3) == "Hujan Ekstrem & Rob"
    assert factor(60, 1) == "Hujan Deras"
    assert factor(0, 3) == "Pasang Rob"
    assert factor(0, 1) == "Tidak Ada"


def test_recommendations(spark):
    assert "aman" in one(spark, risk.recommendation(F.lit(5.0))).lower()
    assert "evakuasi" in one(spark, risk.recommendation(F.lit(120.0))).lower()


def test_gate(spark, rows):
    df = spark.createDataFrame([("AMAN",), ("WASPADA",), ("SIAGA",), ("AWAS",), ("x",), (None,)], "status string")
    assert rows(alerts.alert_gate(df)) == [("AWAS",), ("SIAGA",)]
    assert alerts.alert_gate(df, "unknown").count() == 0
    assert alerts.alert_gate(df, "AMAN").count() == 4


def test_first_alert_per_site_and_status(spark, rows):
    df = spark.createDataFrame([(1, "SIAGA", 3), (1, "SIAGA", 1), (1, "AWAS", 2), (2, "SIAGA", 9)], "loc int, status string, time int")
    assert rows(alerts.first_alerts(df), "loc", "status", "time") == [(1, "AWAS", 2), (1, "SIAGA", 1), (2, "SIAGA", 9)]


@pytest.mark.parametrize("elev,tide,rain,want", [(0.5, 3.8, 0, 0.6), (0.5, 3.8, 50, 1.0), (1.2, 3.8, 0, 0.4), (1.2, 3.8, 30, 0.7), (1.8, 3.8, 0, 0.3), (5.0, 3.8, 90, 0.0)])
def test_inundation(spark, elev, tide, rain, want):
    cols = risk.inundation_columns(F.lit(float(elev)), F.lit(float(tide)), F.lit(float(rain)))
    assert one(spark, cols["heatmap_intensity"]) == want


def test_fixed1_rounds_like_exact_binary(spark):
    rng = random.Random(3)
    values = [i / 20 for i in range(0, 60)] + [round(rng.random() * 500, 2) for _ in range(400)] + [i + 0.25 for i in range(30)] + [-1.25, -0.35, 1e6 + 0.45]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed1("v").alias("t"), text.fixed0("v").alias("z")).collect()
    for r in got:
        assert r.t == f"{r.v:.1f}", r.v
        if r.v >= 0:
            assert r.z == f"{r.v:.0f}", r.v


def test_id_dates(spark):
    days = [dt.date(2024, 12, 9), dt.date(2024, 8, 17), dt.date(2024, 5, 1), dt.date(2024, 10, 6)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(text.format_id_date("d").alias("t")).collect()
    assert [r.t for r in got] == ["Senin, 09 Des", "Sabtu, 17 Agust", "Rabu, 01 Mei", "Minggu, 06 Okt"]


def test_display_names_like_title_case(spark):
    got = spark.createDataFrame([(f,) for f in config.FEATURES_V7], "f string").select("f", text.display_name("f").alias("t")).collect()
    for r in got:
        assert r.t == r.f.replace("_", " ").title()


def test_alert_message_defaults(spark):
    df = spark.createDataFrame([("Pos 1", "SIAGA", 62.5, "", None, dt.datetime(2024, 1, 2, 3, 4))], "location string, status string, depth_cm double, reasoning string, recommendation string, at timestamp_ntz")
    message = alerts.alert_messages(df, "at").first().message
    assert message.startswith("🟠 *PERINGATAN BANJIR - SIAGA*\n")
    assert "62 cm" in message and "02/01/2024 03:04 WITA" in message
    assert config.ALERT_DEFAULT_REASON in message and config.ALERT_DEFAULT_ADVICE in message


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("select risk_level(10) a, risk_label(10) b, risk_label(100) c, risk_level(null) d, api7(array(10D,1D,1D,1D,1D,1D,1D,1D)) e").first()
    assert (r.a, r.b, r.c, r.d) == ("NORMAL", "AMAN", "AWAS", None)
    assert r.e == pytest.approx(10 + sum(0.85**i for i in range(1, 8)))


def test_feature_names():
    assert len(config.FEATURES_V4) == 25 and len(config.FEATURES_V6) == 35 and len(config.FEATURES_V7) == 37
    assert len(set(config.FEATURES_V7)) == 37


def base_row(**changes):
    row = {"rain_sum_imputed": 0.0, "pasut_msl_max": 2.5, "rain_intensity_max": 0.0, "rain_cumsum_7d": 0.0}
    return {**row, **changes}


def test_daily_assessment_invariants(spark):
    rows = [base_row(name="base"), base_row(name="dry", pasut_msl_max=3.8), base_row(name="storm", rain_sum_imputed=80.0, rain_intensity_max=30.0, pasut_msl_max=3.5)]
    out = {r["name"]: r for r in scoring.score_rows(spark.createDataFrame(rows), keep=["name"]).collect()}
    assert all(r.depth_cm >= 0 for r in out.values())
    assert out["dry"].label != "AWAS"
    assert out["storm"].depth_cm >= out["base"].depth_cm


def test_depth_is_capped(spark):
    df = spark.createDataFrame([base_row(rain_intensity_max=500.0)])
    assert scoring.score_rows(df).first().depth_cm == 300


def test_scenario_order(spark):
    """Extreme rain is worst; tide alone, ordinary rain and a clear day stay below the highest band."""
    names = ["rain_sum_imputed", "rain_intensity_max", "soil_moisture_surface_mean", "soil_moisture_root_mean", "pasut_msl_max", "hujan_lag1", "hujan_lag2"]
    data = {"extreme": (150, 50, 0.6, 0.6, 1.5, 20, 10), "tide": (0, 0, 0.3, 0.3, 3.1, 0, 0), "rain": (20, 5, 0.3, 0.3, 1.0, 0, 0), "clear": (0, 0, 0.4, 0.4, 2.0, 0, 0)}
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in data.items()], ["name", *names])
    out = {r["name"]: r for r in scoring.score_rows(df, keep=["name"]).collect()}
    assert out["extreme"].label == "AWAS"
    assert all(out[k].label == "AMAN" for k in ("tide", "rain", "clear"))
    assert out["extreme"].rain_lag1 == 20 and out["extreme"].rain_cumsum_3d == 180


def test_defaults_single_row(spark):
    row = features.daily_features(spark.createDataFrame([(7.0,)], "rain_rolling_24h double")).first()
    assert row.rain_sum_imputed == 7 and row.soil_moisture_surface_mean == 0.45 and row.month_cos == 1
    assert row.hour_risk_factor == 1 and row.elevation_m == 2 and row.drainage_capacity == 50 and row.is_rainy_season == 1


def test_drain_index_not_clipped_for_single_rows(spark):
    assert features.daily_features(spark.createDataFrame([(500.0,)], "rain_cumsum_7d double")).first().drain_capacity_index == 2.5


def test_dry_high_tide_series_stays_below_awas(spark):
    df = spark.sql("select 1L as loc, explode(sequence(timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-01 23:00:00', interval 1 hour)) as time").withColumns(
        {"precipitation": F.lit(0.0), "est": F.lit(3.8), "soil_moisture_surface": F.lit(0.5)}
    )
    scored = scoring.score_series(df)
    assert scored.count() == 24
    assert scoring.max_depth(scored).first().max_depth_cm < 100
    full = features.hourly_features(df)
    assert full.count() == 24 and full.columns == ["loc", "time", *config.FEATURES_V7]


def test_select_model_features_reports_missing(spark):
    df = spark.createDataFrame([(1.0, None)], "rain_lag1 double, rain_lag2 double")
    out, missing = features.select_model_features(df, ["rain_lag2", "nope", "rain_lag1"])
    assert out.columns == ["rain_lag2", "rain_lag1"] and missing == ["nope"]
    assert tuple(out.first()) == (0.0, 1.0)
    assert features.align_features(df, ["nope", "rain_lag1"]).columns == ["nope", "rain_lag1"]


def test_what_if_replaces_only_given_values(spark, rows):
    base = spark.createDataFrame([(1, 5.0, 2.0)], "id int, rain double, tide double")
    out = features.what_if(base, [{"scenario": "a"}, {"scenario": "b", "rain": 9.0, "soil": 0.5}])
    assert rows(out, "scenario", "id", "rain", "tide", "soil") == [("a", 1, 5.0, 2.0, None), ("b", 1, 9.0, 2.0, 0.5)]
