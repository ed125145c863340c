"""Radius, nearest and budget joins over grid cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.functions import geo

#: Cells are wide enough up to this latitude; points beyond it, or whose neighbours lie across the 180th meridian, are refused.
HIGHEST_LAT = 60.0


def cells_for(radius_m: float) -> tuple[float, float]:
    """Degrees of longitude and latitude of cells of which a radius spans one at most."""
    lat = radius_m / geo.DEGREE_M * 1.000001
    return lat / math.cos(math.radians(HIGHEST_LAT)), lat


def grid_join(left: DataFrame, right: DataFrame, radius_m: float, lon: tuple[str, str] = ("lon", "lat"), other: tuple[str, str] = ("lon2", "lat2"), on: Sequence[str] = ()) -> DataFrame:
    """All pairs within radius_m, with dist_m: an equi-join on cells, the right side standing in its cell and all around.

    Rows that share their coordinates are one place, and only places meet in cells; the rows of both sides are then
    joined to their pairs of places by plain equi-joins, so no distance is measured twice and no pair is made in vain.
    Rows with a null or NaN coordinate have no pairs. on: columns of both sides in which a pair agrees; all others
    must differ in name. A point beyond HIGHEST_LAT or within a cell of the 180th meridian is an error, as its pairs
    would be missed.
    """
    wide, high = cells_for(radius_m)

    def cells(x: str, y: str) -> dict[str, Column]:
        far = (F.abs(F.col(y)) > HIGHEST_LAT) | (F.abs(F.col(x)) > 180 - wide)
        column = F.when(far, F.raise_error(F.lit(f"grid_join: a point beyond {HIGHEST_LAT:g} degrees of latitude or next to the 180th meridian"))).otherwise(geo.cell(F.col(x), wide))
        return {"_cx": column, "_cy": geo.cell(F.col(y), high)}

    ok = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    mine, theirs = left.filter(ok(*lon)), right.filter(ok(*other))
    # One side is refused before its shuffle and one after, so that two refusals at once don't hide what they say.
    here = mine.select(*lon, *on).distinct().withColumns(cells(*lon))
    there = theirs.select(*other, *on).withColumns(cells(*other)).distinct()
    near = near_places(here, there, radius_m, lon, other, on)
    # Spark takes a file's size for that of what is made of it, so it would broadcast whole tables through the driver.
    met = theirs.hint("merge").join(near.hint("merge"), [*other, *on])
    columns = [*[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    return mine.hint("merge").join(met.hint("merge"), [*lon, *on]).select(*on, *columns, "dist_m")


def near_places(here: DataFrame, there: DataFrame, radius_m: float, lon: tuple[str, str], other: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """The pairs within radius_m of different places with their cells, _cx and _cy, for grid_join."""
    around = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = there.withColumn("_d", F.explode(around)).withColumns({"_cx": F.col("_cx") + F.col("_d.x"), "_cy": F.col("_cy") + F.col("_d.y")}).drop("_d")
    dist = geo.haversine_m(F.col(lon[0]), F.col(lon[1]), F.col(other[0]), F.col(other[1]))
    return here.hint("merge").join(spread.hint("merge"), ["_cx", "_cy", *on]).withColumn("dist_m", dist).filter(F.col("dist_m") <= radius_m).drop("_cx", "_cy")


def expanding_radius(pairs: DataFrame, key: str, radii: Sequence[float]) -> DataFrame:
    """Of pairs within the largest radius, those within the first radius that has any for the key; ring numbers it."""
    ring = F.lit(len(radii) - 1)
    for i in reversed(range(len(radii) - 1)):
        ring = F.when(F.col("dist_m") <= radii[i], i).otherwise(ring)
    first = F.min("ring").over(Window.partitionBy(key))
    return pairs.withColumn("ring", ring).withColumn("_first", first).filter("ring = _first").drop("_first")


def nearest(pairs: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """The nearest pair of each key, ties by the other side's id; combined before the shuffle."""
    rest = [c for c in pairs.columns if c not in keys]
    ordered = F.struct("dist_m", tie, *[c for c in rest if c not in ("dist_m", tie)])
    return pairs.groupBy(*keys).agg(F.min(ordered).alias("_n")).select(*keys, "_n.*")


def nearest_within(left: DataFrame, right: DataFrame, radii: Sequence[float], key: str, tie: str) -> DataFrame:
    """key, tie, ring, dist_m: of each row of left(key, lon, lat) the nearest of right(tie, lon2, lat2) within the first radius that has any.

    Ties go to the lesser id. All rows of a place have the same answer, so it is found once a place.
    """
    spots = left.groupBy("lon", "lat").agg(F.min(key).alias("_spot"))
    least = right.groupBy("lon2", "lat2").agg(F.min(tie).alias(tie))
    pairs = grid_join(spots, least, max(radii)).select("_spot", "lon", "lat", tie, "dist_m")
    best = nearest(expanding_radius(pairs, "_spot", radii), ["_spot"], tie).select("lon", "lat", tie, "ring", "dist_m")
    return nearest(left.join(best.hint("merge"), ["lon", "lat"]).select(key, tie, "ring", "dist_m"), [key], tie)


def budget_join(heads: DataFrame, tails: DataFrame, reach_m: float, limit_s: float, least_m: float, seconds: Column) -> DataFrame:
    """Pairs of heads(head_id, lon, lat, at_s) and tails(tail_id, lon2, lat2, rest_s) that a ride joins within limit_s.

    seconds: the ride's time as an expression of dist_m. Pairs nearer than least_m are left out.
    """
    met = grid_join(heads, tails, reach_m).filter(F.col("dist_m") >= least_m).withColumn("ride_s", seconds)
    return met.withColumn("total_s", F.col("at_s") + F.col("ride_s") + F.col("rest_s")).filter(F.col("total_s") <= limit_s)
