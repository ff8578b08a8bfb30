import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.operators import neighbours
from hydrolake.plans import datasets, models


@pytest.fixture(scope="module")
def cloud(spark):
    """Clustered points, one cluster with most rows, exact copies among them."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.05, (260, 3)), rng.normal(3, 1, (60, 3)), rng.normal(-4, 0.5, (30, 3))])
    x[10:20] = x[10]
    y = np.array([0] * 260 + [1] * 60 + [2] * 30)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    return x, y, df.cache()


def brute(x, ids, k):
    out = {}
    for i in ids:
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in ids if j != i)[:k]
        out[i] = [(j, pytest.approx(v, abs=1e-9)) for v, j in d]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.neighbour, r.distance))
    return out


@pytest.mark.parametrize("pivots,block", [(1, 1000), (12, 40), (7, 10)])
def test_knn_equals_brute_force(cloud, pivots, block):
    x, y, df = cloud
    assert as_dict(neighbours.knn(df.repartition(5), 4, pivots=pivots, block_rows=block)) == brute(x, range(len(x)), 4)


def test_knn_within_class(cloud):
    x, y, df = cloud
    want = {}
    for c in (0, 1, 2):
        want.update(brute(x, np.nonzero(y == c)[0].tolist(), 3))
    assert as_dict(neighbours.knn(df, 3, within="y", pivots=9, block_rows=50)) == want


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert as_dict(neighbours.knn(df, 5)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}


def test_smote_balances_and_stays_on_segments(cloud):
    x, y, df = cloud
    grown = neighbours.smote(df, k=3)
    assert {r.y: r["count"] for r in grown.groupBy("y").count().collect()} == {0: 260, 1: 260, 2: 260}
    near = {c: brute(x, np.nonzero(y == c)[0].tolist(), 3) for c in (1, 2)}
    for r in grown.where("copy > 0").collect():
        p = np.array(r.x)
        ok = False
        for j, _ in near[r.y][r.id]:
            a, b = x[r.id], x[j]
            t = np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300)
            ok |= -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), p, atol=1e-9)
        assert ok


def test_rows_without_a_class_are_a_class(spark):
    rows = [(i, [float(i), 0.0], 1) for i in range(8)] + [(100 + i, [float(i), 5.0], None) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    near = neighbours.knn(df, 2, within="y")
    assert {r.id for r in near.collect()} == {r[0] for r in rows}
    assert near.where((F.col("id") >= 100) != (F.col("neighbour") >= 100)).count() == 0
    grown = neighbours.smote(df, k=2)
    assert {r.y: r["count"] for r in grown.groupBy("y").count().collect()} == {1: 8, None: 8}
    assert neighbours.enn_filter(df, 2).count() == 12


def test_enn_keeps_smallest_class_and_clean_rows(cloud):
    x, y, df = cloud
    near = brute(x, range(len(x)), 3)
    want = {i for i in near if y[i] == 2 or all(y[j] == y[i] for j, _ in near[i])}
    assert {r.id for r in neighbours.enn_filter(df, 3).collect()} == want


def test_depth_noise_is_bounded_and_repeatable(spark):
    df = spark.range(400).select(
        F.col("id").alias("loc"), F.lit("2024-01-01").cast("date").alias("tanggal"), (F.col("id") % 3).cast("int").alias("label"),
        F.lit(10.0).alias("rain_intensity_max"), F.lit(2.0).alias("pasut_msl_max"))
    a = {r["loc"]: r.water_depth_cm for r in datasets.depth_target(df).collect()}
    b = {r["loc"]: r.water_depth_cm for r in datasets.depth_target(df.repartition(7)).collect()}
    assert a == b
    for loc, v in a.items():
        lo, hi = datasets.BASE_DEPTH_CM[loc % 3]
        assert lo + 15 <= v <= hi + 25
    dry = df.withColumn("rain_intensity_max", F.lit(0.0)).withColumn("label", F.lit(0))
    assert datasets.depth_target(dry).agg(F.max("water_depth_cm")).first()[0] == 0


def test_v4_drops_duplicates_and_unknown_labels(spark):
    rows = [(1, "2024-01-01", 5.0, 1.0, 0.4, 0.4, 2.0, "Aman"), (1, "2024-01-01", 7.0, 1.0, 0.4, 0.4, 2.0, "Banjir"), (1, "2024-01-02", 60.0, 1.0, 0.4, 0.6, 3.0, "Banjir"), (1, "2024-01-03", 1.0, 1.0, 0.4, 0.4, 2.0, None)]
    df = spark.createDataFrame(rows, "loc int, d string, rain_sum_imputed double, rain_intensity_max double, soil_moisture_surface_mean double, soil_moisture_root_mean double, pasut_msl_max double, status_siaga string").withColumn("tanggal", F.to_date("d")).drop("d")
    out = datasets.dataset_v4(df).orderBy("tanggal").collect()
    assert [r.label for r in out] == [0, 2]
    assert out[1].rain_lag1 == 5 and out[1].is_heavy_rain == 1 and out[1].is_high_tide == 1 and out[1].soil_saturation_index == 0.5
    assert datasets.dataset_v4(df).columns == ["loc", "tanggal", *config.FEATURES_V4, "label", "status_siaga"]


def test_stored_v4_plus_events_equals_direct_v6(spark):
    from hydrolake.catalog.training_queries import event_days
    from hydrolake.sources import relations as rel

    d = "/root/testdata/sf0.001"
    hourly = rel.obs_hourly(spark, d)
    days, upstream = event_days(spark, d), hourly.select("loc", "time", "upstream_precipitation")
    direct = datasets.dataset_v6(days, hourly, upstream)
    staged = datasets.add_v6_features(datasets.dataset_v4(days), hourly, upstream).select(*direct.columns)
    key = lambda rows: sorted((r["loc"], r.tanggal, *[round(float(r[c]), 9) for c in config.FEATURES_V6]) for r in rows)
    assert key(direct.collect()) == key(staged.collect())


def test_numeric_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "a int, b string, c double, d boolean")
    assert datasets.numeric_columns(df, exclude=["c"]) == ["a"]


@pytest.fixture(scope="module")
def separable(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("a"), F.sin("id").alias("b"), F.when(F.col("id") % 10 >= 8, 1).otherwise(0).alias("y")).cache()


def test_learners_separate_easy_classes(separable):
    for spec in (models.Forest(trees=5, depth=5), models.Logistic(), models.Boosting(rounds=20)):
        model = models.fit(separable, spec, ["a", "b"], "y")
        r = models.evaluate(models.positive_probability(model, separable), "y").first()
        assert r.auc > 0.99 and r.f1 > 0.9
    table = models.importances(models.fit(separable, models.Forest(trees=5, depth=5), ["a", "b"], "y"))
    assert table.orderBy(F.desc("importance")).first().feature == "a" and table.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert models.dominant(table).first().balanced is False


def test_stack_beats_chance_and_compare_marks_one(separable):
    specs = [models.Forest(trees=3, depth=4), models.Logistic()]
    ensemble = models.stack(separable, specs, ["a", "b"], "y", "id", folds=2)
    assert models.evaluate(ensemble.transform(separable), "y").first().auc > 0.95
    table = models.compare(separable, specs, ["a", "b"], "y", "id", folds=3).collect()
    assert len(table) == 2 and sum(r.is_best for r in table) == 1 and all(r.folds == 3 for r in table)
    each = models.fold_scores(separable, specs, ["a", "b"], "y", "id", folds=3).collect()
    for r in table:
        f1 = [e.f1 for e in each if e.model == r.model]
        assert len(f1) == 3 and r.f1 == pytest.approx(np.mean(f1)) and r.f1_spread == pytest.approx(np.std(f1))


def test_multiclass_boosting_and_depth_model(separable):
    three = separable.withColumn("y", (F.col("a") / 4).cast("int"))
    model = models.fit(three, models.Boosting(rounds=4, loss="softmax", balanced=True), ["a", "b"], "y")
    scored = model.predict(three, 0, "p")
    named = F.array_position("p", F.array_max("p")) - 1
    assert scored.select(F.avg((named == F.col("y")).cast("int"))).first()[0] > 0.95
    assert scored.select(F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1))).first()[0] < 1e-9
    depth = models.fit(separable.withColumn("d", F.col("a") * 3), models.Boosting(rounds=60, loss="squared", l2=0.0), ["a", "b"], "d")
    error = depth.predict(separable.withColumn("d", F.col("a") * 3), 0, "p").select(F.max(F.abs(F.col("d") - F.col("p")))).first()[0]
    assert error < 0.2


def test_training_sets_are_resampled_inside_folds(separable):
    """The copies that a fold's training set gets come from that set alone, and the threshold is the tuned one."""
    seen = []

    def doubled(train):
        seen.append(train.select("fold").distinct().collect())
        return train.unionByName(train.where("y = 1"))

    specs = [models.Boosting(rounds=2, depth=2), models.Logistic()]
    trained = models.train_ensemble(separable, specs, ["a", "b"], "y", "id", folds=3, resample=doubled)
    assert sorted(sorted(r.fold for r in s) for s in seen) == [[0, 1], [0, 1, 2], [0, 2], [1, 2]]
    out = trained.transform(separable)
    assert 0 < trained.threshold < 1 and out.where((F.col("score") >= trained.threshold) != (F.col("prediction") == 1)).count() == 0
    assert models.evaluate(out, "y", "score", trained.threshold).first().f1 > 0.9


def test_scoring_with_a_fitted_model(spark):
    from hydrolake.plans import features, scoring
    from hydrolake.sources import relations as rel

    hourly = rel.obs_hourly(spark, "/root/testdata/sf0.001")
    train = features.hourly_features(hourly).withColumn("depth", F.col("rain_intensity_max") * 2.0)
    model = models.fit(train, models.Boosting(rounds=30, depth=4, loss="squared", l2=0.0), ["rain_intensity_max", "pasut_msl_max", "rain_lag1"], "depth")
    scored = scoring.score_series(hourly, model)
    assert scored.count() == hourly.count()
    low, top = scored.agg(F.min("depth_cm"), F.max("depth_cm")).first()
    assert low >= 0 and top > 20
    day = scoring.score_rows(spark.createDataFrame([(30.0, 2.0)], "rain_intensity_max double, pasut_msl_max double"), model).first()
    assert day.depth_cm > 20


def test_knn_copies_a_row_once_a_block_and_hands_on_few_rows_at_a_time(spark, monkeypatch):
    """Nothing can be left out in 16 dimensions: rows go to all blocks, but not once more for each of 64 partitions."""
    x = np.random.default_rng(3).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    made, kind = [], type(df)
    put = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema, *a, **b: (made.append((f, schema)), put(self, f, schema, *a, **b))[1])
    near = neighbours.knn(df, 3, pivots=64, block_rows=500)
    route = next(f for f, schema in made if "x array" in schema and "radius" not in schema)
    frames = list(route(iter([pd.DataFrame({"id": range(len(x)), "g": "", "x": list(x)})])))
    assert sum(len(f) for f in frames) <= len(x) * 8 and max(len(f) for f in frames) <= 512 * 8
    assert as_dict(near) == brute(x, range(len(x)), 3)


def test_nearest_rows_far_from_the_origin_ties_and_own_ids():
    """Where scalar products cancel, distances are still those of differences; equal distances go by id."""
    rng = np.random.default_rng(5)
    data = np.concatenate([1e6 + rng.normal(size=(60, 5)) * 1e-3, np.full((6, 5), 1e6)])
    ids = np.concatenate([np.arange(60), [60, 60, 61, 62, 63, 64]])
    got: dict = {}
    for q, n, d in neighbours._nearest(ids, data, ids, data, 4):
        for row in zip(q, n, d):
            got.setdefault(row[0], []).append(row[1:])
    for i in range(60):
        dist = np.sqrt(((data - data[i]) ** 2).sum(1))
        want = sorted((dist[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:4]
        assert [n for n, _ in got[i]] == [n for _, n in want] and [d for _, d in got[i]] == pytest.approx([d for d, _ in want], rel=1e-9)
    assert [n for n, d in got[64]] == [60, 60, 61, 62] and all(d == 0 for _, d in got[64])
