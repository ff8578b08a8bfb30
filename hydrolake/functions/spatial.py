"""Geometry on plain lon/lat columns (WGS84 degrees)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions.numeric import clip, col


def ring_centroid(ring: str | Column) -> tuple[Column, Column]:
    """Mean vertex of an outer ring array<struct<lon,lat>>, closing vertex included."""
    r = col(ring)

    def mean(field: str) -> Column:
        return F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[field]) / F.size(r)

    return mean("lon"), mean("lat")


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting: odd number of edges crossed going east."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        # the guard keeps horizontal edges (a.lat = b.lat) out of the division
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return F.when(spans & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return (n > 3) & (hits % 2 == 1)


def segment_distance(px, py, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Distance in degrees from a point to one segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    if length2 == 0:
        return F.sqrt((px - x1) ** 2 + (py - y1) ** 2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.lit(length2)))
    qx, qy = px - (F.lit(x1) + t * dx), py - (F.lit(y1) + t * dy)
    return F.sqrt(qx * qx + qy * qy)


def river_distance_m(lon: str | Column, lat: str | Column, rivers=None) -> Column:
    """Metres to the nearest river centre line.

    The line set is configuration of a handful of vertices, so it is unrolled into the
    expression: no join, no shuffle.
    """
    px, py = col(lon), col(lat)
    parts = [
        segment_distance(px, py, *a, *b)
        for line in (rivers or config.RIVERS).values()
        for a, b in zip(line, line[1:])
    ]
    return F.least(*parts) * F.lit(config.METRES_PER_DEGREE)


def tile_pixel(lat: str | Column, lon: str | Column, zoom: int = 8) -> dict[str, Column]:
    """Web-map tile and pixel inside the 256-pixel tile."""
    n = F.lit(2.0**zoom)
    phi = F.radians(col(lat))
    x = (col(lon) + F.lit(180.0)) / F.lit(360.0) * n
    # asinh(tan(phi)) written as ln(tan + sec)
    y = (F.lit(1.0) - F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)) / F.lit(2.0) * n
    xt, yt = x.cast("int"), y.cast("int")

    def pixel(value: Column, tile: Column) -> Column:
        return clip(((value - tile) * 256).cast("int"), 0, 255).cast("int")

    return {"x_tile": xt, "y_tile": yt, "x_pixel": pixel(x, xt), "y_pixel": pixel(y, yt)}


def cell_of(value: str | Column, origin: float, size: float) -> Column:
    return F.floor((col(value) - F.lit(origin)) / F.lit(size)).cast("long")
