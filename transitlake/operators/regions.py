"""Points in regions with holes, by an index of boundary edges; points in none snap to the nearest region; regions made of members."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions import geo
from transitlake.plans.storage import settled

#: Degrees of the cells in which points meet the edges that their ray may cross.
CELL_LON, CELL_LAT = 0.05, 0.01
#: Half the width of the box that a nearest region is looked for in, at least: over 2.5 km at 39 degrees.
BOX_DEG, HIGHEST_LAT = 0.03, 39.0


def edges(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ax, ay, bx, by: the sides of all rings, outer ones and holes alike, of regions(keys, rings array<array<struct<lon,lat>>>).

    A ring's last vertex may be left out. Sides of no length are left out.
    """
    ring = regions.select(*keys, F.explode("rings").alias("r")).filter(F.size("r") > 1)
    pairs = F.transform("r", lambda p, i: F.struct(p["lon"].alias("ax"), p["lat"].alias("ay"), F.get(F.col("r"), F.pmod(i + 1, F.size("r")))["lon"].alias("bx"), F.get(F.col("r"), F.pmod(i + 1, F.size("r")))["lat"].alias("by")))
    return ring.select(*keys, F.explode(pairs).alias("e")).select(*keys, *[F.col(f"e.{c}").cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]).filter("ax <> bx or ay <> by")


def dissolved(sides: DataFrame, keys: list[str]) -> DataFrame:
    """The sides of the union of the members of each of keys, of edges(keys, ax, ay, bx, by) of members that don't overlap.

    A side that two members share lies within; in the union only those remain that occur an odd number of times,
    whatever their direction. Members must share whole sides, vertex by vertex. Counts are combined before the shuffle.
    """
    turned = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    ends = {"ax": ("ax", "bx"), "ay": ("ay", "by"), "bx": ("bx", "ax"), "by": ("by", "ay")}
    one_way = sides.select(*keys, *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(c) for c, (a, b) in ends.items()])
    return one_way.groupBy(*keys, "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")


def _cells(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(geo.cell(low, width), geo.cell(high, width)))


def containing(points: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """point_id and key of every region that holds a point(point_id, lon, lat) or has it on its boundary.

    A point lies inside if the ray to its east crosses the sides of all rings an odd number of times. Each side lies
    in the cells of its own latitudes and of its region's longitudes, so a point meets the sides of its row of cells
    only, and no region is looked at whole.
    """
    box = sides.groupBy(key).agg(F.min(F.least("ax", "bx")).alias("w"), F.max(F.greatest("ax", "bx")).alias("e"))
    filed = sides.join(box, key).withColumn("cy", _cells(F.least("ay", "by"), F.greatest("ay", "by"), CELL_LAT)).withColumn("cx", _cells(F.col("w"), F.greatest("ax", "bx"), CELL_LON))
    placed = points.withColumns({"cx": geo.cell(F.col("lon"), CELL_LON), "cy": geo.cell(F.col("lat"), CELL_LAT)})
    met = placed.join(filed, ["cx", "cy"]).filter((F.col("lon") >= F.col("w")) & (F.col("lon") <= F.greatest("ax", "bx")))
    x, y, ax, ay, bx, by = (F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by"))
    spans = (ay > y) != (by > y)
    crosses = spans & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
    on = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (x >= F.least(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
    counted = met.groupBy("point_id", key).agg(F.count_if(F.coalesce(crosses, F.lit(False))).alias("n"), F.count_if(on).alias("on"))
    return counted.filter("n % 2 = 1 or on > 0").select("point_id", key)


def nearest_side(points: DataFrame, sides: DataFrame, keys: list[str], box_deg: float) -> DataFrame:
    """point_id, keys and away_m: for each point and region the least distance to a side within box_deg of the point, in metres of a projection around it.

    Sides lie in the cells of that width that they and their surroundings touch, points in one. What lies outside the
    box isn't measured, so a region may be missing or its distance be that to the part within.
    """
    pad = lambda a, b, sign: (F.least(a, b) if sign < 0 else F.greatest(a, b)) + sign * box_deg
    filed = sides.withColumn("cx", _cells(pad("ax", "bx", -1), pad("ax", "bx", 1), box_deg)).withColumn("cy", _cells(pad("ay", "by", -1), pad("ay", "by", 1), box_deg))
    placed = points.withColumns({"cx": geo.cell(F.col("lon"), box_deg), "cy": geo.cell(F.col("lat"), box_deg)})
    met = placed.join(filed, ["cx", "cy"])

    def cut(a: Column, b: Column, at: Column) -> tuple[Column, Column]:
        """The part of a side within the box along one axis, as shares of the side; empty if the first is the greater."""
        d = b - a
        t0, t1 = (at - box_deg - a) / F.nullif(d, F.lit(0.0)), (at + box_deg - a) / F.nullif(d, F.lit(0.0))
        flat = F.abs(a - at) <= box_deg
        return F.when(d == 0, F.when(flat, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1)), F.when(d == 0, F.when(flat, 1.0).otherwise(-1.0)).otherwise(F.greatest(t0, t1))

    x, y = F.col("lon"), F.col("lat")
    (x0, x1), (y0, y1) = cut(F.col("ax"), F.col("bx"), x), cut(F.col("ay"), F.col("by"), y)
    met = met.withColumns({"t0": F.greatest(F.lit(0.0), x0, y0), "t1": F.least(F.lit(1.0), x1, y1)}).filter("t0 <= t1")
    ends = [geo.local_xy(F.col("ax") + (F.col("bx") - F.col("ax")) * F.col(t), F.col("ay") + (F.col("by") - F.col("ay")) * F.col(t), x, y) for t in ("t0", "t1")]
    zero = F.lit(0.0)
    away = geo.segment_m(zero, zero, *ends[0], *ends[1])
    return met.groupBy("point_id", *keys).agg(F.min(away).alias("away_m"))


def assign_regions(points: DataFrame, regions: DataFrame, snap_m: float = 2_000.0, sides: DataFrame | None = None) -> DataFrame:
    """point_id, region, method, snap_dist_m, drop_reason and detail of points(point_id, lon, lat).

    regions(region, name, in_scope, rings); sides, edges(region, ax, ay, bx, by), takes the place of rings. A point
    goes to the region that holds it, the boundary included, method contain; of several to one in scope, then to the
    least, and detail says tie: and all of them. One that only regions out of scope hold is dropped as outside_region
    with contained: and the name. One in none snaps to the nearest region within the box if that is in scope and within
    snap_m; else it is dropped with nearest:, name and metres, or far. Coordinates that aren't numbers or lie outside
    124 to 132 degrees east or 33 to 39 north are invalid_coord. Points that share an id must not differ.
    """
    number = {c: F.expr(f"try_cast({c} as double)") for c in ("lon", "lat")}
    at = points.select("point_id", *[c.alias(n) for n, c in number.items()]).distinct()
    valid = settled(at.filter(geo.in_box(F.col("lon"), F.col("lat"))), "points")
    sides = settled(edges(regions, ["region"]) if sides is None else sides, "sides")
    rank = regions.select("region", "name", "in_scope", F.struct((~F.col("in_scope")).alias("out"), "region").alias("rank"))
    held = containing(valid, sides, "region").join(rank, "region")
    home = held.groupBy("point_id").agg(F.min(F.struct("rank", "name", "in_scope")).alias("h"), F.array_sort(F.collect_list("rank")).alias("all"))
    home = settled(home, "home")
    box = max(BOX_DEG, snap_m / geo.DEGREE_M / math.cos(math.radians(HIGHEST_LAT)))
    loose = valid.join(home, "point_id", "left_anti")
    near = nearest_side(loose, sides, ["region"], box).join(rank, "region").groupBy("point_id").agg(F.min(F.struct("away_m", "rank", "name", "in_scope")).alias("s"))
    every = at.join(home, "point_id", "left").join(near, "point_id", "left")
    snaps = F.coalesce(F.col("s.in_scope") & (F.col("s.away_m") <= snap_m), F.lit(False))
    inside = F.coalesce(F.col("h.in_scope"), F.lit(False))
    ok = geo.in_box(F.col("lon"), F.col("lat"))
    method = F.when(~ok, "").when(inside, "contain").when(F.col("h").isNull() & snaps, "snap").otherwise("")
    tie = F.concat(F.lit("tie:"), F.array_join(F.transform("all", lambda r: r["region"].cast("string")), ","))
    detail = (
        F.when(~ok, "")
        .when(inside, F.when(F.size("all") > 1, tie).otherwise(""))
        .when(F.col("h").isNotNull(), F.concat(F.lit("contained:"), F.col("h.name")))
        .when(F.col("s").isNull(), "far")
        .when(snaps, "")
        .otherwise(F.concat(F.lit("nearest:"), F.col("s.name"), F.format_string(" %.0f m", F.col("s.away_m"))))
    )
    told = every.select("point_id", "h", "s", method.alias("method"), F.when(~ok, "invalid_coord").when(method != "", "").otherwise("outside_region").alias("drop_reason"), detail.alias("detail"))
    region = F.when(F.col("method") == "contain", F.col("h.rank.region")).when(F.col("method") == "snap", F.col("s.rank.region"))
    return told.select("point_id", region.alias("region"), "method", F.when(F.col("method") == "snap", F.round("s.away_m", 1)).alias("snap_dist_m"), "drop_reason", "detail")
