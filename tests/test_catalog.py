"""Registered queries against their oracles on the smallest tables.

tools/check_oracles.py does the same for all of them and any scale.
"""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "hourly_risk_status", "hourly_feature_store", "rain_streaks", "api_recursive", "lag_backfill", "calendar_lags", "dataset_v1", "dataset_v4",
    "dataset_v6", "forecast_7day", "feedback_agreement", "buildings_at_risk", "zonal_percentiles", "tide_outliers", "flow_accumulation",
    "tide_fit", "smote", "enn_filter", "upsample_classes", "pr_curve", "alert_messages", "risk_reasons", "stream_rolling",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry_shape():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    without = {n for n in set(queries) - set(oracles) if not n.startswith("op") and n != "pipeline"}
    assert all(n.startswith(("train_", "stacked", "compare", "tuned", "feature_importances")) for n in without)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: repr(v)
    want = sorted(tuple(norm(v) for v in row) for row in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == want
