"""Domain relations derived from the star-schema tables, so that every operator has real input.

All of them grow with the tables: sites come from users and suppliers, zones from suppliers,
buildings from customers, raster cells from parts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrolake import config
from hydrolake.functions import calendar
from hydrolake.operators.timegrid import gap_fill

EPOCH_DAY_2024 = 19723  # 2024-01-01
EPOCH_DAY_1995 = 9131  # 1995-01-01


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star-schema table. Its schema is read from the file once; later reads start no job for it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def gauge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gauge readings: one row per reading with its location."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr("user_id div 5").alias("loc"),
        "ts",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        "event_type",
        "value",
    )


def obs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings that exist: one row per (loc, hour) with at least one event."""

    def of(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value"))

    return (
        gauge_events(spark, sf_dir)
        .groupBy("loc", "time")
        .agg(
            F.round(F.sum(of("purchase")) / 5, 2).alias("precipitation"),
            F.round(F.least(F.max(of("click")) / 100, F.lit(1.0)), 4).alias("soil_moisture_surface"),
            F.round(F.least(F.max(of("view")) / 100, F.lit(1.0)), 4).alias("soil_moisture_root"),
            F.round(F.max(of("signup")) / 10, 3).alias("wind_speed"),
            F.round(F.sum(of("error")) / 5, 2).alias("upstream_precipitation"),
        )
    )


def obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly series per location with rain, soil, wind, upstream rain and tide."""
    defaults = {**config.HOURLY_DEFAULTS, "upstream_precipitation": 0.0}
    # the time span comes from the raw column: a scan without a shuffle
    hours = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    span = table(spark, sf_dir, "events").select(F.struct(F.min(hours).alias("a"), F.max(hours).alias("b"))).scalar()
    dense = gap_fill(obs_sparse(spark, sf_dir), defaults, start=span.getField("a"), end=span.getField("b"))
    hr = calendar.hour_number("time") - EPOCH_DAY_2024 * 24
    phase = (hr.cast("double") + F.lit(0.5) * F.col("loc")) * F.lit(2 * math.pi)
    m2, k1 = config.CONSTITUENT_PERIOD_H["M2"], config.CONSTITUENT_PERIOD_H["K1"]
    tide = F.lit(2.5) + F.lit(0.9) * F.cos(phase / F.lit(m2)) + F.lit(0.5) * F.cos(phase / F.lit(k1))
    return dense.withColumn("est", F.round(tide, 2))


def tide_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tide of every hour, to be joined to readings by place and hour.

    A join that reads only these columns loses the readings behind the dense hours, and Spark then sizes them by the spans
    they are laid out from, a few bytes a place: as a broadcast, all hours would meet on the driver. So they are merged.
    """
    return obs_hourly(spark, sf_dir).select("loc", "time", "est").hint("merge")


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily training rows per location; days without readings are absent."""
    li = table(spark, sf_dir, "lineitem")
    total = F.sum("l_quantity")
    score = total + F.max(F.when(F.col("l_returnflag") == "R", 10).otherwise(0))
    daily = li.groupBy(F.col("l_suppkey").alias("loc"), F.to_date("l_shipdate").alias("tanggal")).agg(
        total.alias("rain_sum_imputed"),
        (F.max("l_quantity") / 4).alias("rain_intensity_max"),
        F.round(F.max("l_discount") * 10, 2).alias("soil_moisture_surface_mean"),
        F.round(F.max("l_tax") * 10, 2).alias("soil_moisture_root_mean"),
        score.alias("_score"),
    )
    dn = (calendar.day_number("tanggal") - EPOCH_DAY_1995 + F.col("loc")).cast("double")
    return daily.select(
        "loc",
        "tanggal",
        "rain_sum_imputed",
        "rain_intensity_max",
        "soil_moisture_surface_mean",
        "soil_moisture_root_mean",
        F.round(F.lit(2.5) + F.lit(1.2) * F.cos(F.lit(2 * math.pi) * dn / F.lit(14.765)), 2).alias("pasut_msl_max"),
        F.when(F.col("_score") > 80, "Banjir").when(F.col("_score") > 45, "Air Meluap").otherwise("Aman").alias("status_siaga"),
    )


def status_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field reports (loc, tanggal, status_siaga): several per day, some days without, some unlabelled."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("loc"),
        F.to_date("l_shipdate").alias("tanggal"),
        F.col("l_orderkey").alias("report_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "Banjir")
        .when(F.col("l_quantity") > 40, "Air Meluap")
        .when(F.col("l_quantity") > 2, "Aman")
        .alias("status_siaga"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular zones on a 50-wide grid, with mean elevation and share of low land."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    gx, gy = (k % 50).alias("gx"), F.expr("s_suppkey div 50").alias("gy")
    z = s.select(
        k.alias("zone_id"),
        F.col("s_name").alias("zone"),
        gx,
        gy,
        (((k * 7) % 25) / 4.0 - 1.0).alias("mean_elev"),
        ((k * 37) % 100).cast("double").alias("risk_pct"),
    )
    return z.withColumns(
        {
            "lon0": F.round(F.lit(117.05) + F.lit(0.0034) * F.col("gx"), 6),
            "lat0": F.round(F.lit(-0.58) + F.lit(0.008) * F.col("gy"), 6),
            "lon1": F.round(F.lit(117.05) + F.lit(0.0034) * (F.col("gx") + 1), 6),
            "lat1": F.round(F.lit(-0.58) + F.lit(0.008) * (F.col("gy") + 1), 6),
        }
    )


def zone_rings(zone_table: DataFrame) -> DataFrame:
    """Zones with their outer ring: four corners and the closing vertex."""
    corners = [("lon0", "lat0"), ("lon1", "lat0"), ("lon1", "lat1"), ("lon0", "lat1"), ("lon0", "lat0")]
    ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners])
    return zone_table.withColumn("ring", ring)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    amenity = (
        F.when(F.col("c_mktsegment") == "BUILDING", "school")
        .when(F.col("c_mktsegment") == "MACHINERY", "hospital")
        .when(F.col("c_mktsegment") == "FURNITURE", "clinic")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "kindergarten")
    )
    return c.select(
        F.col("c_custkey").alias("id"),
        F.round(F.lit(117.05) + ((F.col("c_custkey") * 7919) % 1700) / 10000.0 + 0.00005, 6).alias("lon"),
        F.round(F.lit(-0.58) + ((F.col("c_custkey") * 104729) % 1600) / 10000.0 + 0.00005, 6).alias("lat"),
        F.col("c_name").alias("name"),
        amenity.alias("amenity"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation cells, 50 columns wide: a valley along column 25 with rough ground; -9999 = no data."""
    p = table(spark, sf_dir, "part")
    row, c = F.expr("p_partkey div 50"), F.col("p_partkey") % 50
    height = F.round(F.lit(0.4) * row + F.lit(0.2) * F.abs(c - 25) + F.col("p_size") / 50.0, 2)
    return p.select(
        row.alias("row"),
        c.alias("col"),
        F.when(F.col("p_partkey") % 97 == 5, F.lit(-9999.0)).otherwise(height).alias("value"),
        F.expr("p_partkey div 250").alias("zone_id"),
    )


def tide_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular gauge readings: several stations, microsecond times."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    wave = F.lit(0.9) * F.cos(F.lit(2 * math.pi) * seconds / F.lit(44714.16))
    return e.select(
        F.expr("user_id div 50").alias("station"),
        F.col("ts").alias("t"),
        F.round(F.lit(2.5) + wave + F.col("value") / 2000, 4).alias("est"),
        F.round(wave + F.col("value") / 2000, 4).alias("msl"),
        F.round(F.lit(1.1) + wave + F.col("value") / 2000, 4).alias("lt"),
    )


def pred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions as logged."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.expr("user_id div 5").alias("loc"),
        (v / 2).alias("depth_cm"),
        v.alias("rain_24h"),
        F.round(F.lit(2.0) + (F.col("event_id") % 20) / 10.0, 1).alias("tide_level"),
        F.least(v / 200, F.lit(1.0)).alias("probability"),
        F.when(v / 2 < 20, "AMAN").when(v / 2 < 50, "WASPADA").when(v / 2 < 100, "SIAGA").otherwise("AWAS").alias("risk_level"),
        F.when(F.col("event_type") == "error", "Banjir")
        .when(F.col("event_type") == "purchase", "Air Meluap")
        .when(F.col("event_type") == "view", "Aman")
        .alias("actual_outcome"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier output: id, label y, score."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return l.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), (F.col("n_chars") / 200000.0).alias("score")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
