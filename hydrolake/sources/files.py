"""CSV, JSON responses, GeoJSON, building tables, model metadata and run metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake import config

# --- CSV -----------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, dates: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header under an explicit schema; ``dates`` maps text columns to their date format."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: F.to_date(c, f) for c, f in (dates or {}).items()})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a data set. Parquet by default; CSV gets a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


# --- columnar JSON responses ---------------------------------------------------------------------


def json_arrays_to_rows(raw: DataFrame, block: str, fields: Mapping[str, str], column: str = "value", time_format: str = "yyyy-MM-dd'T'HH:mm", keep: Sequence[str] = ()) -> DataFrame:
    """Responses {"<block>": {"time": [...], "a": [...], ...}} to one row per time.

    ``fields`` maps names in the response to column names. Arrays are zipped by position; a shorter
    or missing one gives NULLs. Numbers parse as double.
    """
    arrays = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] + [T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])
    parsed = raw.select(*keep, F.from_json(column, T.StructType([T.StructField(block, arrays)])).alias("_j"))
    present = lambda f: F.coalesce(F.col(f"_j.{block}.{f}"), F.array())
    zipped = F.arrays_zip(*[present(f).alias(f) for f in ["time", *fields]])
    rows = parsed.select(*keep, F.explode(zipped).alias("_r"))
    return rows.select(
        *keep,
        F.to_timestamp_ntz("_r.time", F.lit(time_format)).alias("time"),
        *[F.col(f"_r.`{f}`").alias(name) for f, name in fields.items()],
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON responses, one document per file, as column ``value`` with its file name."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def attach_values(axis: DataFrame, values: str, name: str, time: str = "time") -> DataFrame:
    """Pair a start/step description with its value array: one row per value at start + i * step."""
    return axis.select("*", F.posexplode(values).alias("_i", name)).withColumn(
        time, F.expr("start + make_dt_interval(0, 0, 0, 1) * (_i * step_seconds)")
    ).drop("_i", values)


# --- GeoJSON -------------------------------------------------------------------------------------


def geojson_schema(properties: Mapping[str, str]) -> T.StructType:
    props = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in properties.items()])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", props), T.StructField("geometry", geometry)])
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature))])


def outer_ring(geometry: Column) -> Column:
    """Outer ring as array<struct<lon,lat>>; of a MultiPolygon the first part; else NULL.

    Coordinates arrive as JSON text because their nesting depends on the geometry type.
    """
    text = geometry["coordinates"]
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    ring = F.when(geometry["type"] == "Polygon", F.get(polygon, F.lit(0))).when(
        geometry["type"] == "MultiPolygon", F.get(F.get(multi, F.lit(0)), F.lit(0))
    )
    return F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def geojson_features(raw: DataFrame, properties: Mapping[str, str], column: str = "value") -> DataFrame:
    """FeatureCollection documents (or single features) as text to rows: properties and ``ring``."""
    feature = geojson_schema(properties)["features"].dataType.elementType
    both = T.StructType(list(feature.fields) + [geojson_schema(properties)["features"]])
    doc = raw.select(F.from_json(column, both).alias("d"))
    features = F.coalesce(F.col("d.features"), F.array(F.struct("d.type", "d.properties", "d.geometry")))
    f = doc.select(F.explode(features).alias("f"))
    return f.select(*[F.col(f"f.properties.{p}").alias(p) for p in properties], outer_ring(F.col("f.geometry")).alias("ring"))


def read_geojson(spark: SparkSession, path: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    props = properties or {"NAMOBJ": "string", "mean_elev": "double", "risk_pct": "double"}
    return geojson_features(spark.read.text(path, wholetext=True), props)


def feature_text(df: DataFrame, properties: Sequence[str], ring: str = "ring") -> DataFrame:
    """One GeoJSON feature per row, as column ``value`` (line-delimited GeoJSON when written)."""
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: Sequence[str], ring: str = "ring") -> None:
    feature_text(df, properties, ring).write.mode("overwrite").text(path)


# --- tables --------------------------------------------------------------------------------------

BUILDING_COLUMNS = ("id", "geometry", "lon", "lat", "building", "name", "amenity")


def keep_existing(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def read_buildings(spark: SparkSession, path: str, keep: Sequence[str] = BUILDING_COLUMNS) -> DataFrame:
    """Building table with the wanted columns that exist; the others are never read."""
    return keep_existing(spark.read.parquet(path), keep)


def sites(spark: SparkSession) -> DataFrame:
    """Monitoring sites as a dimension table."""
    return spark.createDataFrame(
        [(i, *s) for i, s in enumerate(config.SITES)], "site_id long, site string, lat double, lon double, runoff double"
    )


def upstream_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(config.UPSTREAM_SITES)], "site_id long, site string, lat double, lon double")


# --- model metadata and runs ---------------------------------------------------------------------


def read_model_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feature list (position, feature) and metrics (name, value) of a model's metadata document."""
    schema = "features array<string>, metrics map<string,double>, model_type string, description string"
    meta = spark.read.schema(schema).option("multiLine", True).json(path)
    return meta.select(F.posexplode("features").alias("position", "feature")), meta.select(F.explode("metrics").alias("name", "value"))


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """The model's feature names in order: a few dozen, needed to build the plan."""
    return [r.feature for r in read_model_meta(spark, path)[0].orderBy("position").collect()]


def run_rows(run: Column, kind: str, values: Mapping[str, Column]) -> Column:
    """Array of (run, kind, name, value) to explode into the long run table."""
    return F.array(
        *[F.struct(run.alias("run"), F.lit(kind).alias("kind"), F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]
    )


def log_run(rows: DataFrame, path: str) -> None:
    rows.select("run", "kind", "name", "value").write.mode("append").partitionBy("kind").parquet(path)


def pivot_runs(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per run, one column per name. Naming the columns spares the pass that looks for them."""
    return long.groupBy("run").pivot("name", list(names)).agg(F.max("value"))


def best_run(long: DataFrame, name: str) -> DataFrame:
    """The run with the largest value of a metric; of equal ones the first by name."""
    m = long.where((F.col("kind") == "metric") & (F.col("name") == name))
    key = F.struct(-F.col("value"), F.col("run"))
    return m.agg(F.min_by("run", key).alias("run"), F.max("value").alias("value"))
