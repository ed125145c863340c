"""Operators against brute force and hand-made cases."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transitlake.functions import costs, geo, names, times
from transitlake.operators import graphs, journeys, registry, sequences, service, skyline, spatial
from transitlake.operators.fares import transfer_fares


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "station", "key"),
    [("서울역(1호선)", True, "서울"), ("시청 역", True, "시청"), ("역", True, "역"), ("A·B[가]", False, "ab"), ("가(나(다))라", False, "가라"), ("ＡＢＣ", False, "abc"), ("", False, "")],
)
def test_name_key(spark, name, station, key):
    assert one(spark, names.name_key(F.col("n"), station), n=name) == key


@pytest.mark.parametrize(("a", "b", "ok"), [("강남", "강남", True), ("강남역", "강남역앞", True), ("강남", "강남역", False), ("가나다", "나가다", False)])
def test_compatible(spark, a, b, ok):
    assert one(spark, names.compatible(F.col("a"), F.col("b")), a=a, b=b) is ok


@pytest.mark.parametrize(("code", "out"), [("123", "00123"), ("123456", "123456"), ("0", ""), ("", ""), ("A1", "A1")])
def test_padded_number(spark, code, out):
    assert one(spark, names.padded_number(F.col("c")), c=code) == out


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("380", "M7", "9-1", "10", "9")], "n string")
    assert [r.n for r in rows.orderBy(names.natural_key(F.col("n"))).collect()] == ["9", "9-1", "10", "380", "M7"]


def test_guidance(spark):
    a, b = names.guidance(F.col("g"))
    assert one(spark, F.concat_ws("/", a, b), g="2호선 (시청(1) > 강남 > 역삼)") == "시청(1) > 강남/역삼"


@pytest.mark.parametrize(("s", "m"), [("05:30", 330), ("24:47:00", 1487), ("20250101053000", 330), ("", None), ("x", None)])
def test_minutes(spark, s, m):
    assert one(spark, times.minutes_of(F.col("s")), s=s) == m


@pytest.mark.parametrize(("first", "last", "at", "ok"), [(300, 600, 400, True), (1380, 120, 30, True), (1380, 120, 600, False), (None, 120, 600, True)])
def test_in_service(spark, first, last, at, ok):
    assert one(spark, times.in_service(F.col("a").cast("int"), F.col("b"), F.col("c")), a=first, b=last, c=at) is ok


def test_haversine_nan(spark):
    assert math.isnan(one(spark, geo.haversine_m(F.col("a"), F.lit(37.0), F.lit(127.0), F.lit(37.0)), a=float("nan")))
    assert one(spark, geo.haversine_m(F.lit(127.0), F.lit(37.0), F.lit(127.0), F.lit(38.0)), a=1) == pytest.approx(geo.DEGREE_M)


@pytest.mark.parametrize(("km", "fare"), [(10.0, 1550), (10.001, 1650), (15.0, 1650), (50.0, 2350), (50.001, 2450), (58.001, 2550)])
def test_rail_fare(spark, km, fare):
    assert one(spark, costs.rail_fare(F.lit(1550), F.col("km")), km=km) == fare


def test_taxi_reach_inverts_time(spark):
    assert one(spark, costs.taxi_reach_m(costs.taxi_s(F.col("m"), F.lit("peak")), F.lit("peak")), m=4200.0) == pytest.approx(4200)


def test_first_wait(spark):
    a = F.array(F.lit(60), F.lit(400), F.lit(None).cast("int"))
    assert one(spark, costs.first_wait_s(a, F.col("w"), F.lit(300)), w=100) == 300
    assert one(spark, costs.first_wait_s(a, F.col("w"), F.lit(300)), w=900) == 100
    assert one(spark, costs.first_wait_s(a, F.col("w"), F.lit(None).cast("int")), w=900) is None


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(126, 127), rng.uniform(37, 37.5)) for i in range(120)]
    a = spark.createDataFrame([*pts, (999, float("nan"), 37.0)], "id long, lon double, lat double")
    b = a.toDF("id2", "lon2", "lat2")
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    want = {(r.id, r.id2) for r in a.join(b, F.coalesce(d <= 7000, F.lit(False)) & ~F.isnan(d)).select("id", "id2").collect()}
    assert {(r.id, r.id2) for r in spatial.grid_join(a, b, 7000).select("id", "id2").collect()} == want


def test_fronts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.randrange(12), float(rng.randrange(12))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, id int, time_s long, fare double")
    beats = lambda a, b: a[2] <= b[2] and a[3] <= b[3] and a[2:] != b[2:]
    on = {r[1] for r in rows if not any(x[0] == r[0] and beats(x, r) for x in rows)}
    assert {r.id for r in skyline.front_with_ties(df, ["k"], "time_s", "fare", "id").collect()} == on
    first = {}
    for r in rows:
        if r[1] in on:
            first.setdefault((r[0], *r[2:]), r[1])
    assert {r.id for r in skyline.front(df, ["k"], "time_s", "fare", "id").collect()} == set(first.values())
    kept = {r[1]: int(r[1] not in on) for r in rows if not any(x[0] == r[0] and r[2] - x[2] > 3 and r[3] - x[3] >= 2 for x in rows)}
    assert {r.id: r.tier for r in skyline.banded(df, ["k"], "time_s", "fare", 3, 2.0).collect()} == kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9]
    nodes = spark.range(60).select("id")
    got = {r.id: r.root for r in graphs.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 if i <= 40 and i // 10 < 4 else i for i in range(60)}


@pytest.mark.parametrize("seed", range(3))
def test_exact_front(spark, seed):
    rng = random.Random(seed)
    n = 5
    edges = [(str(a), str(b), rng.choice(["walk", "taxi"]), float(rng.randrange(13)), float(rng.randrange(13))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5]
    found = set()

    def walk(node, taxis, time, fare, seen):
        if node == str(n - 1):
            found.add((time, fare))
            return
        for a, b, mode, dt, df in edges:
            if a == node and b not in seen and taxis + (mode == "taxi") <= 1:
                walk(b, taxis + (mode == "taxi"), time + dt, fare + df, seen | {b})

    walk("0", 0, 0.0, 0.0, {"0"})
    want = {c for c in found if not any(d != c and d[0] <= c[0] and d[1] <= c[1] for d in found)}
    got = graphs.exact_front(spark.createDataFrame(edges, "start string, end string, mode string, time_s double, fare double"), "0", str(n - 1))
    assert {(r.time_s, r.fare) for r in got.collect()} == want


def fares(spark, journeys_):
    """journeys_: rides of (board_s, alight_s, km, base, free_km, mode, route) with early and taxi as further, optional fields."""
    rows = [(name, i, *r[:7], *(r[7:] or (0.0, False))) for name, rides in journeys_.items() for i, r in enumerate(rides)]
    df = spark.createDataFrame(rows, "journey string, pos int, board_s double, alight_s double, km double, base double, free_km double, mode string, route string, early double, taxi boolean")
    return {r.journey: (r.fare, r.groups) for r in transfer_fares(df).collect()}


def test_transfer_fares(spark):
    bus, rail = (1500.0, 10.0, "flat"), (1550.0, 10.0, "rail", "r")
    got = fares(spark, {
        "in time": [(36000.0, 36600.0, 8.0, *bus, "1"), (38400.0, 39000.0, 8.0, *rail)],  # one group of 16 km
        "a second late": [(36000.0, 36600.0, 8.0, *bus, "1"), (38401.0, 39000.0, 8.0, *rail)],
        "same bus": [(36000.0, 36600.0, 1.0, *bus, "1"), (36700.0, 37000.0, 1.0, *bus, "1")],
        "train and bus of one name": [(36000.0, 36600.0, 1.0, 1550.0, 10.0, "rail", "1"), (36700.0, 37000.0, 1.0, *bus, "1")],
        "night": [(79000.0, 79600.0, 1.0, *bus, "1"), (83000.0, 83600.0, 1.0, *bus, "2")],
        "gates": [(36000.0, 36600.0, 8.0, *rail), (36700.0, 37000.0, 4.0, *rail)],  # one ride of 12 km
        "taxi between": [(36000.0, 36600.0, 8.0, *rail), (36700.0, 37000.0, 4.0, *rail, 0.0, True)],
        "early": [(20000.0, 20600.0, 5.0, *rail, 310.0, False)],
        "early, second group": [(36000.0 - 14000, 22600.0, 5.0, *rail, 310.0, False), (100000.0, 100600.0, 5.0, *rail, 310.0, True)],
        "capped bus": [(36000.0, 36600.0, 60.0, 1650.0, 10.0, "bus", "1")],
        "far rail": [(36000.0, 36600.0, 82.0, *rail)],
        "flat alone": [(36000.0, 36600.0, 60.0, *bus, "1")],
        "never refunded": [(36000.0, 36600.0, 16.0, 1650.0, 10.0, "bus", "1"), (36700.0, 37000.0, 1.0, 3200.0, 30.0, "flat", "2")],
    })
    assert got == {
        "in time": (1750.0, 1), "a second late": (3050.0, 2), "same bus": (3000.0, 2), "train and bus of one name": (1550.0, 1), "night": (1500.0, 1), "gates": (1650.0, 1), "taxi between": (3100.0, 2), "early": (1240.0, 1), "early, second group": (2790.0, 2),
        "capped bus": (2350.0, 1), "far rail": (2750.0, 1), "flat alone": (1500.0, 1), "never refunded": (3400.0, 1),
    }


def test_distinct_cards_keep_the_first(spark):
    rows = [("q", 0, 30, 5000, 0.0, 0.0, 9.0, 9.0), ("q", 1, 30, 5000, 150.0, 0.0, 9.0, 9.0), ("q", 2, 30, 5000, 300.0, 0.0, 9.0, 9.0), ("q", 3, 31, 5000, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, pos int, minutes int, fare int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.pos for r in journeys.distinct_cards(df, "k").collect()) == [0, 2, 3]


def test_assign_in_order(spark):
    rows = [("s", 0, 0.0, 900.0), ("s", 1, 500.0, 900.0), ("s", 1, 2000.0, 950.0), ("s", 2, 800.0, 900.0), ("s", 3, 760.0, 900.0)]
    df = spark.createDataFrame(rows, "k string, stop int, along double, score double")
    assert sorted((r.stop, r.along) for r in journeys.assign_in_order(df, "k").collect()) == [(0, 0.0), (1, 500.0), (2, 800.0), (3, 760.0)]


def test_assign_in_order_is_best_of_all_choices(spark):
    """Every choice of at most one option a stop is tried."""
    import itertools

    rng, rows, want = random.Random(5), [], {}
    for k in range(25):
        options = [[(float(rng.randrange(0, 400)), float(rng.randrange(1, 50))) for _ in range(rng.randint(0, 3))] for _ in range(4)]
        rows += [(str(k), stop, a, s) for stop, many in enumerate(options) for a, s in many]
        totals = [sum(s for _, s in pick) for chosen in itertools.product(*[[None, *many] for many in options]) for pick in [[c for c in chosen if c]] if all(x[0] <= y[0] + 50 for x, y in zip(pick, pick[1:]))]
        want[str(k)] = max(totals)
    got = {}
    for r in journeys.assign_in_order(spark.createDataFrame(rows, "k string, stop int, along double, score double"), "k").collect():
        got[r.k] = got.get(r.k, 0.0) + r.score
    assert got == {k: v for k, v in want.items() if v}


def test_passes(spark):
    path = spark.createDataFrame([("p", i, float(d)) for i, d in enumerate([10, 20, 500, 500, 30, 5, 600])], "path_id string, seg long, away double")
    points = spark.createDataFrame([("p", "x")], "path_id string, point_id string")
    got = sorted((r.first_seg, r.last_seg, r.seg) for r in journeys.passes(points, path, 100, F.col("away")).collect())
    assert got == [(0, 1, 0), (4, 5, 5)]


def test_joined_chains(spark):
    chains = spark.createDataFrame([(1, "L", ["a", "b"]), (2, "L", ["b", "c"]), (3, "M", ["b", "z"])], "chain_id int, line string, stops array<string>")
    got = {tuple(r.stops) for r in sequences.joined_chains(chains).collect()}
    assert got == {("a", "b", "c")}


def test_mapped_fails_on_an_unknown_code(spark):
    rows, codes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, code string"), spark.createDataFrame([("a", "bus")], "code string, kind string")
    with pytest.raises(Exception, match="unknown code"):
        registry.mapped(rows, codes, "code").collect()
    with pytest.raises(ValueError, match="keys"):
        registry.require_empty(registry.duplicates(spark.createDataFrame([(1,), (1,)], "id int"), ["id"]), "keys repeat")


def test_running_clock_reads_the_hour_of_boarding(spark):
    legs = spark.createDataFrame([("j", 0, 30.0, "1"), ("j", 1, 10.0, "1")], "k string, pos int, ride_m double, line string")
    headways = F.create_map(F.lit("1:9"), F.lit(20.0), F.lit("1:10"), F.lit(6.0))
    got = service.running_clock(legs.withColumn("h", headways), "k", F.lit(570), F.col("h")).first()
    assert (got.arrive_m, got.wait_m) == (570 + 10 + 30 + 3 + 10, 13)


def test_day_types(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d, h),) for d, h in ((5, 1), (6, 3), (7, 5))], "t timestamp")
    assert [(r.a, r.b) for r in rows.orderBy("t").select(times.day_type(F.col("t")).alias("a"), times.rail_hour(F.col("t")).alias("b")).collect()] == [("평일", 25), ("토요일", None), ("일요일", 5)]


def test_toward(spark):
    chains = spark.createDataFrame([("o", True, list("abcdef")), ("l", False, list("abcdef"))], "chain string, is_loop boolean, stops array<string>")
    rides = spark.createDataFrame([(1, "o", "a", "c"), (2, "o", "a", "e"), (3, "o", "a", "d"), (4, "l", "e", "a"), (5, "l", "a", "f"), (6, "l", "a", "z")], "ride_id int, chain string, board string, alight string")
    assert {r.ride_id: r.toward for r in sequences.toward(chains, rides).collect()} == {1: "b", 2: "f", 3: "b", 4: "d", 5: "b"}


def test_progress(spark):
    path = spark.createDataFrame([("p", 0, 0.0, 0.0, 100.0, 0.0), ("p", 1, 100.0, 0.0, 100.0, 50.0)], "k string, seg int, ax double, ay double, bx double, by double")
    got = sequences.progress(path, spark.createDataFrame([("p", 104.0, 20.0)], "k string, x double, y double"), "k").first()
    assert (got.done_m, got.left_m, got.off_m) == (120.0, 30.0, 4.0)


def test_live_names(spark):
    stations = spark.createDataFrame([("1", "L", ["강남역"]), ("2", "L", ["없음", "시청(1)"]), ("3", "L", ["역삼"]), ("4", "M", ["강남"])], "station_id string, line_id string, names array<string>")
    live = spark.createDataFrame([("L", "강남"), ("L", "시청")], "line_id string, live_name string")
    over = spark.createDataFrame([("3", "선릉")], "station_id string, live_name string")
    assert {r.station_id: (r.live_name, r.match) for r in registry.live_names(stations, live, over).collect()} == {"1": ("강남", "exact"), "2": ("시청", "alias"), "3": ("선릉", "override"), "4": (None, "none")}


def test_freshness(spark):
    df = spark.createDataFrame([("a", "2023-01-05"), ("a", "2024.02.01"), ("a", "1900-01-00"), ("a", "")], "k string, d string")
    r = registry.freshness(df, "k", times.parse_date(F.col("d")), "2024-01-01").first()
    assert (str(r["first"]), str(r["last"]), r.stale, r.missing) == ("2023-01-05", "2024-02-01", 1, 2)


def test_brackets_of_any_depth_go(spark):
    rows = [("가나(다(라(마(바(사)))))역",), ("a(b)(c(d))",), ("open(only",), ("plain",), (None,)]
    got = spark.createDataFrame(rows, "n string").select(names.name_key(F.col("n")).alias("k"))
    assert [r.k for r in got.collect()] == ["가나역", "a", "open(only", "plain", None]


def test_points_that_cells_cannot_hold_are_refused(spark):
    far = spark.createDataFrame([(1, 10.0, 80.0)], "a int, lon double, lat double")
    other = spark.createDataFrame([(2, 10.1, 80.0)], "b int, lon2 double, lat2 double")
    with pytest.raises(Exception, match="latitude"):
        spatial.grid_join(far, other, 5000.0).collect()
    with pytest.raises(Exception, match="meridian"):
        spatial.grid_join(far.withColumns({"lat": F.lit(10.0), "lon": F.lit(179.999)}), other.withColumn("lat2", F.lit(10.0)), 5000.0).collect()
