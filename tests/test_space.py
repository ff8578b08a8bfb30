import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.functions import spatial as sf
from hydrolake.operators import raster, spatial, tide


def polygon(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [*points, points[0]]])


def inside(points, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]


def test_ray_casting(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-1, 5), rng.uniform(-1, 4)) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double").select("id", sf.in_ring(polygon(L_SHAPE), F.col("lon"), F.col("lat")).alias("hit"))
    assert {r.id: r.hit for r in df.collect()} == {i: inside(L_SHAPE, x, y) for i, x, y in pts}


def test_centroid_counts_closing_vertex(spark):
    lon, lat = sf.ring_centroid("ring")
    r = spark.range(1).select(polygon([(0, 0), (4, 0), (4, 2), (0, 2)]).alias("ring")).select(lon.alias("x"), lat.alias("y")).first()
    assert (r.x, r.y) == (8 / 5, 4 / 5)


@pytest.mark.parametrize("cell,spread", [(0.5, 1), (0.01, 8), (10.0, 3)])
def test_spatial_join_equals_brute_force(spark, cell, spread):
    rng = random.Random(9)
    # two thirds of the points share one spot
    pts = [(i, 0.5, 0.5) if i % 3 else (i, rng.random(), rng.random()) for i in range(200)]
    boxes = [(j, x := rng.random() * 0.8, y := rng.random() * 0.8, x + rng.random() * 0.3, y + rng.random() * 0.3) for j in range(20)]
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    b = spark.createDataFrame(boxes, "zone_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.id, r.zone_id) for r in spatial.spatial_join(p, b, cell=cell, spread=spread).collect()}
    assert got == {(i, j) for i, x, y in pts for j, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}


def test_impact_counts(spark):
    hits = spark.createDataFrame([(1, "school", 1, "n"), (1, "school", 2, "n"), (2, "clinic", 1, None), (3, None, 1, "m")], "id int, amenity string, zone_id int, name string")
    assert tuple(spatial.impact_summary(hits).first()) == (4, 2, 1)
    assert tuple(spatial.impact_summary(hits, distinct=True).first()) == (3, 1, 1)
    assert [tuple(r) for r in spatial.impact_details(hits).collect()] == [("n", "school"), ("n", "school")]


def test_river_distance(spark):
    df = spark.createDataFrame([(117.15, -0.50), (117.13, -0.52)], "lon double, lat double")
    near, on = [r.d for r in df.select(sf.river_distance_m("lon", "lat").alias("d")).collect()]
    assert near < 10_000 and on == pytest.approx(0, abs=1e-6)


def test_tile_pixel(spark):
    lat, lon = -0.5022, 117.1536
    cols = sf.tile_pixel(F.lit(lat), F.lit(lon))
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    x = (lon + 180) / 360 * 256
    y = (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 256
    assert (r.x_tile, r.y_tile, r.x_pixel, r.y_pixel) == (int(x), int(y), int((x - int(x)) * 256), int((y - int(y)) * 256))


def test_wgs84_check(spark):
    bad = spark.createDataFrame([(500_000.0, 9.9e6)], "lon double, lat double")
    with pytest.raises(Exception, match="WGS84"):
        spatial.require_wgs84(bad).collect()


@pytest.fixture(scope="module")
def terrain(spark):
    rng = np.random.default_rng(1)
    z = np.round(rng.random((23, 31)) * 10 + np.arange(23)[:, None], 2)
    z[5, 7] = -9999.0
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(23) for c in range(31)], "row long, col long, value double")
    return z, cells


@pytest.mark.parametrize("tile", [5, 64])
def test_slope_equals_gradient(terrain, tile):
    z, cells = terrain
    dy, dx = np.gradient(z)
    want = np.arctan(np.sqrt(dx**2 + dy**2))
    for r in raster.slope(cells.repartition(3), tile=tile).collect():
        assert r.slope == pytest.approx(want[r.row, r.col], abs=1e-12)


def steepest(z):
    steps = [(code, dr, dc) for _, code, dr, dc in raster.DIRECTIONS]
    out = {}
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if z[r, c] <= -100:
                out[r, c] = None
                continue
            best = (0.0, 0, None)
            for code, dr, dc in steps:
                i, j = r + dr, c + dc
                if 0 <= i < z.shape[0] and 0 <= j < z.shape[1] and z[i, j] > -100:
                    drop = (z[r, c] - z[i, j]) / math.hypot(dr, dc)
                    if drop > best[0] + 1e-15:
                        best = (drop, code, (i, j))
            out[r, c] = best
    return out


@pytest.mark.parametrize("tile", [6, 64])
def test_d8_directions(terrain, tile):
    z, cells = terrain
    want = steepest(z)
    for r in raster.d8(cells, tile=tile).collect():
        w = want[r.row, r.col]
        assert r.direction == (None if w is None else w[1])


def test_flow_accumulation_counts_upstream_cells(terrain):
    z, cells = terrain
    want = steepest(z)
    count = {k: 0 for k, w in want.items() if w is not None}
    for k in count:
        at = k
        while at is not None:
            count[at] += 1
            at = want[at][2]
    got = {(r.row, r.col): r.flow_accumulation for r in raster.flow_accumulation(raster.d8(cells)).collect()}
    assert got == count


def test_flow_accumulation_on_one_long_path(spark):
    line = spark.range(100).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), (F.lit(100.0) - F.col("id")).alias("value"))
    got = {r.col: r.flow_accumulation for r in raster.flow_accumulation(raster.d8(line)).collect()}
    assert got == {c: c + 1 for c in range(100)}


def test_zones_without_cells_get_zero(spark):
    zones = spark.createDataFrame([(1,), (2,), (3,)], "zone_id int")
    cells = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, -9999.0)], "zone_id int, value double")
    got = {r.zone_id: (r.p10_elev, r.p50_elev) for r in raster.zonal_percentiles(zones, cells).collect()}
    assert got == {1: (pytest.approx(1.3), 2.5), 2: (0, 0), 3: (0, 0)}


def test_tide_fit_recovers_constituents(spark):
    rng = np.random.default_rng(8)
    speeds = tide.omegas(("M2", "K1"))
    truth = {1: (2.5, {"M2": (0.9, 0.4), "K1": (0.5, -1.1)}), 2: (1.0, {"M2": (0.3, 2.0), "K1": (0.2, 0.0)})}
    data = []
    for s, (mean, parts) in truth.items():
        for h in np.sort(rng.random(800)) * 24 * 60:
            y = mean + sum(a * math.cos(speeds[n] * h - g) for n, (a, g) in parts.items())
            data.append((s, float(h), y))
    data.append((1, 5.0, None))
    obs = spark.createDataFrame(data, "station int, h double, est double").withColumn("t", F.timestamp_micros((F.col("h") * 3.6e9).cast("long")).cast("timestamp_ntz"))
    model = tide.tide_fit(obs, speeds)
    for r in model.collect():
        a, g = truth[r.station][1][r.name]
        assert r.amplitude == pytest.approx(a, abs=1e-6) and math.cos(r.phase - g) == pytest.approx(1, abs=1e-9)
        assert r["mean"] == pytest.approx(truth[r.station][0], abs=1e-6)
    times = obs.where("est is not null").select("station", "t", F.col("est").alias("true"))
    back = tide.tide_predict(times, model, time="t").select(F.max(F.abs(F.col("est") - F.col("true")))).first()[0]
    assert back < 1e-5


def test_station_without_model_reads_zero(spark):
    model = spark.createDataFrame([(1, "M2", 0.5, 1.0, 0.0, 2.0)], "station int, name string, omega double, amplitude double, phase double, mean double")
    times = spark.sql("select explode(array(1, 9)) as station, timestamp_ntz'2026-01-01 00:00:00' as time")
    got = {r.station: r.est for r in tide.tide_predict(times, model).collect()}
    assert got[9] == 0 and 1 <= got[1] <= 3
    assert tide.tide_predict(times.limit(0), model).count() == 0


def test_nodal_factors_scale_and_shift(spark):
    model = spark.createDataFrame([(1, "M2", 0.0, 1.0, 0.5, 2.0, 1.1, 0.5)], "station int, name string, omega double, amplitude double, phase double, mean double, f double, u double")
    times = spark.sql("select 1 as station, timestamp_ntz'1970-01-01 00:00:00' as time")
    assert tide.tide_predict(times, model).first().est == pytest.approx(2.0 + 1.1)


def test_flow_over_a_cycle_is_an_error(spark):
    rows = [(0, 0, 1, 0, 1), (0, 1, 1, 0, 0), (0, 2, 1, 0, 1)]
    df = spark.createDataFrame(rows, "row int, col int, direction int, to_row int, to_col int")
    with pytest.raises(ValueError, match="cycle"):
        raster.flow_accumulation(df)
