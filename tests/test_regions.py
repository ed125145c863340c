"""Points in regions with holes: limits, ties, snapping, and random shapes against plain geometry; unions of members."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from transitlake.operators import regions

R = 6_371_008.8


def square(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def table(spark, rows):
    """rows: region, name, in_scope, rings."""
    return spark.createDataFrame(rows, "region string, name string, in_scope boolean, rings array<array<struct<lon: double, lat: double>>>")


def told(spark, shapes, points, **more):
    rows = spark.createDataFrame([(i, str(x) if x is not None else None, str(y) if y is not None else None) for i, (x, y) in enumerate(points)], "point_id int, lon string, lat string")
    return {r.point_id: (r.region, r.method, r.snap_dist_m, r.drop_reason, r.detail) for r in regions.assign_regions(rows, shapes, **more).collect()}


@pytest.fixture(scope="module")
def towns(spark):
    """At 37 degrees: one out of scope, a gap, and two that share a side."""
    return table(spark, [("41130", "G", True, [square(127.01, 37.0, 127.02, 37.01)]), ("41110", "G", True, [square(127.0, 37.0, 127.01, 37.01)]), ("28000", "I", False, [square(126.98, 37.0, 126.99, 37.01)])])


def test_contained_tied_and_dropped(spark, towns):
    got = told(spark, towns, [(127.005, 37.005), (127.01, 37.005), (127.015, 37.005), (126.985, 37.005), ("127.005", 37.0), (127.02, 37.01)])
    assert got == {
        0: ("41110", "contain", None, "", ""), 1: ("41110", "contain", None, "", "tie:41110,41130"), 2: ("41130", "contain", None, "", ""), 3: (None, "", None, "outside_region", "contained:I"),
        4: ("41110", "contain", None, "", ""), 5: ("41130", "contain", None, "", ""),
    }


def test_snapped(spark, towns):
    points = [(127.005, 37.0109), (127.005, 37.055), (127.005, 37.0325), (126.9905, 37.005)]
    got = told(spark, towns, points)
    assert got[0][:2] == ("41110", "snap") and abs(got[0][2] - 100.1) < 0.2
    assert got[1][3:] == ("outside_region", "far") and got[2][3:] == ("outside_region", "nearest:G 2502 m")
    assert got[3][3:] == ("outside_region", "nearest:I 44 m")  # the nearer neighbour keeps it from snapping
    assert told(spark, towns, points[:1], snap_m=50.0)[0] == (None, "", None, "outside_region", "nearest:G 100 m")


def test_coordinates_that_cannot_be(spark, towns):
    got = told(spark, towns, [("nan", 37.0), (0.0, 0.0), (127.0, 45.0), (None, 37.0), ("", 37.0), ("x", 37.0), (127.005, "inf"), (123.9, 37.0)])
    assert set(got.values()) == {(None, "", None, "invalid_coord", "")} and len(got) == 8


def test_holes_and_islands(spark):
    """An island in a hole belongs to the region, the hole to its filler."""
    rings = [square(127.0, 37.0, 127.1, 37.1), square(127.02, 37.02, 127.08, 37.08), square(127.04, 37.04, 127.06, 37.06)]
    shapes = table(spark, [("a", "A", True, rings), ("b", "B", True, [square(127.02, 37.02, 127.03, 37.03)])])
    got = told(spark, shapes, [(127.01, 37.05), (127.05, 37.05), (127.025, 37.025), (127.07, 37.07), (127.02, 37.05)])
    assert [got[i][:2] for i in range(5)] == [("a", "contain"), ("a", "contain"), ("b", "contain"), ("a", "snap"), ("a", "contain")]
    assert abs(got[3][2] - math.radians(0.01) * math.cos(math.radians(37.07)) * R) < 1.0


def plain_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def plain_away(x, y, rings, box):
    """Least distance to points along the sides, those within the box."""
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            for k in range(2001):
                px, py = ax + (bx - ax) * k / 2000, ay + (by - ay) * k / 2000
                if abs(px - x) <= box and abs(py - y) <= box:
                    best = min(best, math.hypot(math.radians(px - x) * math.cos(math.radians(y)) * R, math.radians(py - y) * R))
    return best


def test_random_stars(spark):
    rng = random.Random(7)
    shapes = []
    for k in range(8):
        cx, cy = 127 + rng.random() * 0.3, 37 + rng.random() * 0.3
        star = lambda r0, r1, n=rng.randint(5, 14): [(cx + r * math.cos(a), cy + r * math.sin(a)) for i in range(n) for r, a in [(rng.uniform(r0, r1), 2 * math.pi * i / n)]]
        shapes.append((f"r{k}", f"N{k % 3}", k % 4 != 0, [star(0.03, 0.07), star(0.005, 0.02)]))
    points = [(127 + rng.random() * 0.4 - 0.05, 37 + rng.random() * 0.4 - 0.05) for _ in range(400)]
    got = told(spark, table(spark, shapes), points)
    seen = Counter()
    for i, (x, y) in enumerate(points):
        home = sorted((not s, r, n) for r, n, s, rings in shapes if plain_inside(x, y, rings))
        region, method, away, reason, detail = got[i]
        if home:
            out, first, name = home[0]
            want = (None, "", "outside_region", f"contained:{name}") if out else (first, "contain", "", "tie:" + ",".join(r for _, r, _ in home) if len(home) > 1 else "")
            assert (region, method, reason, detail) == want
        else:
            near = sorted((plain_away(x, y, rings, regions.BOX_DEG), not s, r, n) for r, n, s, rings in shapes)
            d, out, first, name = near[0]
            if abs(d - 2000) < 5 or (len(near) > 1 and near[1][0] - d < 5):
                continue
            if math.isinf(d):
                assert detail == "far"
            elif not out and d <= 2000:
                assert (region, method) == (first, "snap") and abs(away - d) < 3
            else:
                assert detail.startswith(f"nearest:{name} ") and abs(int(detail.split()[1]) - d) < 3
        seen[method or detail[:3]] += 1
    assert min(seen[x] for x in ("contain", "snap", "con", "nea", "far")) > 5


def test_union_of_members(spark):
    """Districts of a grid with a hole and a second part: the boundary is closed, and holds what the districts hold."""
    cells = {(x, y) for x in range(4) for y in range(3)} - {(1, 1)} | {(6, 0)}
    corner = lambda x, y: (127 + x * 0.01, 37 + y * 0.01)
    rows = [("u", "U", True, [[corner(x, y), corner(x + 1, y), corner(x + 1, y + 1), corner(x, y + 1)][:: rng]]) for (x, y), rng in zip(sorted(cells), [1, -1] * 20)]
    members = table(spark, rows)
    sides = regions.dissolved(regions.edges(members, ["region"]), ["region"])
    assert sides.count() == 14 + 4 + 4
    ends = Counter()
    for r in sides.collect():
        ends[r.ax, r.ay] += 1
        ends[r.bx, r.by] += 1
    assert all(n % 2 == 0 for n in ends.values())
    points = [(127 + x * 0.01 + 0.005, 37 + y * 0.01 + 0.005) for x in range(-1, 8) for y in range(-1, 4)]
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id int, lon double, lat double")
    one = members.select("region", "name", "in_scope", F.lit(None).cast(members.schema["rings"].dataType).alias("rings")).distinct()
    got = {r.point_id for r in regions.assign_regions(at, one, sides=sides).collect() if r.method == "contain"}
    assert got == {i for i, (x, y) in enumerate(points) if (round((x - 127) / 0.01 - 0.5), round((y - 37) / 0.01 - 0.5)) in cells}


def test_no_points_and_no_regions(spark, towns):
    none = spark.createDataFrame([], "point_id int, lon double, lat double")
    assert regions.assign_regions(none, towns).count() == 0
    assert told(spark, towns.limit(0), [(127.0, 37.0)]) == {0: (None, "", None, "outside_region", "far")}
