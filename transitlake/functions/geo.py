"""Distances, projections and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Metres of one degree of latitude.
DEGREE_M = EARTH_M * 3.141592653589793 / 180


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; null where a coordinate is null, NaN where one is NaN."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() passes over null and NaN, so both are asked for first.
    return F.when(F.isnan(half), F.lit(float("nan"))).when(half.isNotNull(), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), half))))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a nearby origin."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment, all in metres of one projection."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = F.when(size > 0, ((px - ax) * dx + (py - ay) * dy) / F.when(size > 0, size)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def polyline_m(lon: Column, lat: Column, path: Column) -> Column:
    """Distance of a point to a path of (lon, lat) structs: infinite for an empty path, to the vertex for one vertex."""
    x = lambda p: local_xy(p["lon"], p["lat"], lon, lat)[0]
    y = lambda p: local_xy(p["lon"], p["lat"], lon, lat)[1]
    zero = F.lit(0.0)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(path) - 1)), lambda i: segment_m(zero, zero, x(F.get(path, i - 1)), y(F.get(path, i - 1)), x(F.coalesce(F.get(path, i), F.get(path, i - 1))), y(F.coalesce(F.get(path, i), F.get(path, i - 1)))))
    return F.when(F.size(path) == 0, F.lit(float("inf"))).otherwise(F.array_min(parts))


def cell(degrees: Column, width: float) -> Column:
    return F.floor(degrees / width).cast("long")


def in_box(lon: Column, lat: Column, west: float = 124.0, east: float = 132.0, south: float = 33.0, north: float = 39.0) -> Column:
    """Finite coordinates within the service box; null counts as outside."""
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(west, east) & lat.between(south, north)
    return F.coalesce(ok, F.lit(False))
