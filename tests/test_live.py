import math
import random

import pytest

from transitlake.operators import live

ASK = "ride int, stop string, line string, walk_s double, headway_s double, at_s string"
TOLD = "stop string, line string, at_s double, predicted boolean"


def waits(spark, boardings, arrivals):
    b = spark.createDataFrame([(*x, "clash") for x in boardings], ASK)
    return {r.ride: (r.wait_s, r.source) for r in live.first_waits(b, spark.createDataFrame(arrivals, TOLD)).collect()}


def test_sources(spark):
    arrivals = [("s", "1", 100.0, True), ("s", "1", 400.0, False), ("s", "2", None, True), ("s", "1", 400.0, True), (None, "1", 5.0, True), ("t", "1", 50.0, None), ("s", "1", None, None)]
    asked = [(1, "s", "1", 100.0, 60.0), (2, "s", "1", 100.5, 60.0), (3, "s", "1", 401.0, 60.0), (4, "s", "1", 401.0, None), (5, "s", "1", 401.0, 0.0), (6, "s", "2", 1.0, 60.0), (7, "s", "3", 1.0, 60.0), (8, "u", "1", 1.0, 60.0), (9, None, "1", 1.0, 60.0), (10, "t", "1", 1.0, None), (11, "s", "1", 580.0, 60.0)]
    assert waits(spark, asked, arrivals) == {
        1: (0.0, "realtime"), 2: (299.5, "realtime"), 3: (59.0, "realtime+headway"), 4: (None, "missed_all"), 5: (None, "missed_all"), 6: (None, "no_prediction"), 7: (None, "no_match"), 8: (None, "no_arrivals"), 9: (None, "no_arrivals"),
        10: (49.0, "realtime_stops"), 11: (0.0, "realtime+headway"),
    }
    assert waits(spark, asked[:1], []) == {1: (None, "no_arrivals")} and waits(spark, [], arrivals) == {}


@pytest.mark.parametrize("stops", [1, 7])
def test_every_boarding_against_all_arrivals(spark, stops):
    rng = random.Random(stops)
    arrivals = [(f"s{rng.randrange(stops)}", rng.choice("ab"), float(rng.randint(0, 900)), rng.random() < 0.5) for _ in range(400)]
    asked = [(i, f"s{rng.randrange(stops)}", rng.choice("ab"), float(rng.randint(0, 1000)), 70.0) for i in range(500)]
    got = waits(spark, asked, arrivals)
    for i, stop, line, walk, headway in asked:
        mine = [(t, not p) for s, x, t, p in arrivals if (s, x) == (stop, line)]
        caught = min((m for m in mine if m[0] >= walk), default=None)
        if caught:
            assert got[i] == (caught[0] - walk, "realtime_stops" if caught[1] else "realtime")
        else:
            last = max(t for t, _ in mine)
            assert got[i] == (last + math.ceil((walk - last) / headway) * headway - walk, "realtime+headway")


def test_replaced_waits(spark):
    steps = [("r", 0, "WALKING", None, 60.0), ("r", 1, "BUS", 300.0, 600.0), ("r", 2, "SUBWAY", 200.0, 100.0), ("q", 0, "BUS", 10.0, 20.0), ("p", 0, "BUS", None, 20.0)]
    df = spark.createDataFrame(steps, "route string, pos int, type string, wait_s double, time_s double")
    firsts = spark.createDataFrame([("r", 41.6, "realtime"), ("q", None, "missed_all")], "route string, wait_s double, source string")
    got = {(r.route, r.pos): (r.wait_s, r.static_wait_s, r.wait_source, r.total_s) for r in live.replaced_waits(df, firsts).collect()}
    assert got == {("r", 0): (None, None, None, 1002.0), ("r", 1): (42.0, 300.0, "realtime", 1002.0), ("r", 2): (200.0, None, None, 1002.0), ("q", 0): (10.0, None, "missed_all", 30.0), ("p", 0): (None, None, None, None)}
