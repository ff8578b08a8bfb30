"""Zones, buildings and sample points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk, spatial


def zone_inundation(zones: DataFrame, tide: Column, rain: Column) -> DataFrame:
    """Every zone against one hour's tide and rain, given as scalar columns."""
    return zones.withColumns(risk.inundation_columns("mean_elev", tide, rain))


def zone_risk(zones: DataFrame, tide: Column, rain: Column) -> DataFrame:
    """Zone centre with its risk score and label; zones carry ``ring``."""
    lon, lat = spatial.ring_centroid("ring")
    scored = zones.withColumns({"lon": lon, "lat": lat, "risk": risk.zone_risk_score("mean_elev", "risk_pct", rain, tide)})
    return scored.withColumn("risk_label", risk.zone_risk_label("risk"))


def risk_boxes(zones: DataFrame, half_deg: float = 0.005, min_risk: float = 0.5) -> DataFrame:
    """Square around the centre of every zone above ``min_risk``."""
    return zones.where(F.col("risk") > min_risk).withColumns(
        {
            "x0": F.col("lon") - half_deg,
            "y0": F.col("lat") - half_deg,
            "x1": F.col("lon") + half_deg,
            "y1": F.col("lat") + half_deg,
        }
    )


def spatial_join(
    points: DataFrame,
    areas: DataFrame,
    point_key: str = "id",
    cell: float = 0.01,
    ring: str | None = None,
    spread: int = 8,
) -> DataFrame:
    """Points inside areas; a point appears once per area that holds it, borders included for boxes.

    Areas carry a box x0, y0, x1, y1 (and optionally a polygon ``ring`` inside it). Both sides meet
    on grid cells: a point lies in one cell, an area is listed in each cell its box covers. Points of
    a cell are spread over ``spread`` salts, and the area rows repeated per salt, so that a crowded
    cell is worked on by several tasks.
    """

    def index(value: str) -> Column:
        return F.floor(F.col(value) / F.lit(cell)).cast("long")

    salted = points.withColumns(
        {
            "_cx": index("lon"),
            "_cy": index("lat"),
            "_salt": F.pmod(F.xxhash64(point_key), F.lit(spread)).cast("int"),
        }
    )
    covered = (
        areas.withColumn("_cx", F.explode(F.sequence(index("x0"), index("x1"))))
        .withColumn("_cy", F.explode(F.sequence(index("y0"), index("y1"))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    )
    inside = (
        F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    )
    hits = salted.join(covered, ["_cx", "_cy", "_salt"]).where(inside)
    if ring:
        hits = hits.where(spatial.in_ring(F.col(ring), F.col("lon"), F.col("lat")))
    return hits.drop("_cx", "_cy", "_salt")


def ring_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds the bounding box of a polygon ring."""

    def edge(pick, field):
        return pick(F.transform(ring, lambda p: p[field]))

    return df.withColumns(
        {
            "x0": edge(F.array_min, "lon"),
            "y0": edge(F.array_min, "lat"),
            "x1": edge(F.array_max, "lon"),
            "y1": edge(F.array_max, "lat"),
        }
    )


def impact_summary(hits: DataFrame, distinct: bool = False, key: str = "id") -> DataFrame:
    """Affected buildings, schools and hospitals. A building in two areas counts twice unless distinct."""
    base = hits.groupBy(key).agg(F.first("amenity").alias("amenity")) if distinct else hits
    return base.agg(
        F.count(F.lit(1)).alias("total_affected"),
        F.count_if(F.col("amenity").isin(config.SCHOOL_AMENITIES)).alias("schools_affected"),
        F.count_if(F.col("amenity").isin(config.HOSPITAL_AMENITIES)).alias("hospitals_affected"),
    )


def impact_details(hits: DataFrame, n: int = 10, order: Sequence[str] = ("id", "zone_id")) -> DataFrame:
    """First n affected buildings that have a name and an amenity."""
    return hits.na.drop(subset=["name", "amenity"]).orderBy(*order).limit(n).select("name", "amenity")


def lowest_zones(zones: DataFrame, n: int = 10, tie: str = "zone_id") -> DataFrame:
    return zones.orderBy(F.asc("mean_elev"), F.asc(tie)).limit(n).select(
        F.col("zone").alias("kelurahan"), F.col("risk_pct").alias("persen_dataran_rendah"), "mean_elev"
    )


def geo_grid(box: DataFrame, n: int = 20) -> DataFrame:
    """n x n evenly spaced points over each box (x0, y0, x1, y1), corners included."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    g = box.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))

    def at(a: str, b: str, k: str) -> Column:
        return F.col(a) + F.col(k) * ((F.col(b) - F.col(a)) / F.lit(n - 1))

    return g.select(*[c for c in box.columns if c not in ("x0", "y0", "x1", "y1")], "i", "j",
                    at("y0", "y1", "i").alias("lat"), at("x0", "x1", "j").alias("lon"))


def sample_raster(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Cell values under points; 0 outside the raster. ``dy`` is negative for north-up rasters."""
    placed = points.withColumns({"row": spatial.cell_of("lat", y0, dy), "col": spatial.cell_of("lon", x0, dx)})
    cells = raster.select("row", "col", *columns)
    return placed.join(cells, ["row", "col"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def site_features(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """elevation, slope, twi, flow_accumulation under each point and the distance to the river.

    ``raster`` carries value, slope, twi and flow_accumulation per cell.
    """
    s = sample_raster(points, raster, x0, y0, dx, dy, ["value", "slope", "twi", "flow_accumulation"])
    return s.withColumnRenamed("value", "elevation").withColumn("river_dist_m", spatial.river_distance_m("lon", "lat"))


def require_wgs84(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Fails the job on the first coordinate that cannot be WGS84 degrees."""
    ok = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    return df.withColumn(lon, F.when(ok, F.col(lon)).otherwise(F.raise_error(F.lit("coordinates are not WGS84 degrees"))))
