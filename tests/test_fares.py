"""Fares by the tariff: the cases of its limits, choices of routes against their product, prices that aren't known."""

import itertools
import random
from datetime import datetime

import pytest

from transitlake.operators import fares

STEP = "journey string, pos int, type string, distance_m double, time_s double, wait_s double, line_group string, board_name string, alight_name string, stops array<string>, fare_routes array<struct<id:string,name:string,source:string,type:string>>"
DAY = datetime(2026, 9, 23, 12)


def bus(km, rid="a", kind="일반", source="gyeonggi", wait=0.0, more=()):
    routes = [(rid, rid, source, kind), *more]
    return ("BUS", None if km is None else km * 1000.0, 600.0, wait, None, None, None, None, routes)


def rail(km, line="2호선", board=None, alight=None):
    return ("SUBWAY", km * 1000.0, 600.0, 0.0, line, board, alight, None, None)


def other(kind, seconds):
    return (kind, None, float(seconds), None, None, None, None, None, None)


TAXI = other("TAXI", 600)


def told(spark, cases):
    """cases: name -> steps, or (steps, at, initial walk)."""
    cases = {k: v if isinstance(v, tuple) else (v, DAY, 0.0) for k, v in cases.items()}
    steps = spark.createDataFrame([(k, i, *s) for k, (v, _, _) in cases.items() for i, s in enumerate(v)], STEP)
    journeys = spark.createDataFrame([(k, 9999.0, at, walk) for k, (_, at, walk) in cases.items()], "journey string, fallback double, at timestamp, initial_walk_s double")
    return {r.journey: r for r in fares.fare_options(journeys, steps).collect()}


LIMITS = {
    **{f"general {km}": ([bus(km)], won) for km, won in ((10, 1650), (10.001, 1750), (15, 1750), (40, 2250), (40.001, 2350), (90, 2350))},
    **{f"seoul {kind}": ([bus(60, kind=kind, source="seoul")], won) for kind, won in (("간선", 1500), ("지선", 1500), ("순환", 1400), ("마을", 1200), ("광역", 3000))},
    **{f"gyeonggi {kind}": ([bus(80, kind=kind)], won) for kind, won in (("좌석", 2650), ("직행", 3200), ("광역", 3900), ("순환", 4150))},
    **{f"rail {km}": ([rail(km)], won) for km, won in ((10, 1550), (10.001, 1650), (50, 2350), (50.001, 2450), (58, 2450), (58.001, 2550))},
    "night bus": ([bus(60, "N1", "간선", "seoul")], 2500),
    "distances add up": ([bus(8), TAXI, bus(8, "b")], 1850),
    "bus and rail": ([bus(8, source="seoul", kind="간선"), rail(8)], 1750),
    "thirty free": ([bus(9), bus(24, "b", kind="직행")], 3300),
    "not over singles": ([bus(100, source="seoul", kind="간선"), bus(100, "b", source="seoul", kind="간선")], 3000),
    "not given back": ([bus(16), bus(1, "b", kind="직행")], 3400),
    "30 minutes": ([bus(1), other("TAXI", 1800), bus(1, "b")], 1650),
    "a second more": ([bus(1), other("TAXI", 1801), bus(1, "b")], 3300),
    "wait counts": ([bus(1), other("WALKING", 900), bus(1, "b", wait=901.0)], 3300),
    "same bus": ([bus(1), bus(1)], 3300),
    "sixth": ([bus(1, str(i)) for i in range(6)], 3300),
    "within the gates": ([rail(8), rail(4)], 1650),
    "out of the gates": ([rail(8), TAXI, rail(4)], 3100),
    "rail and bus of one name": ([rail(1), bus(1, "rail")], 1650),
    "nothing": ([], 0),
    "only a walk": ([other("WALKING", 60)], 0),
}


def test_limits(spark):
    got = told(spark, {k: v for k, (v, _) in LIMITS.items()})
    assert {k: r.value for k, r in got.items()} == {k: float(won) for k, (_, won) in LIMITS.items()}
    assert {r.source for r in got.values()} == {"rules_estimate"}
    assert got["distances add up"].transfer_kept is True and got["a second more"].transfer_kept is False and got["same bus"].transfer_kept is None


def test_early_and_night(spark):
    at = lambda h, m, s=0: datetime(2026, 9, 23, h, m, s)
    got = told(spark, {
        "early": ([rail(1)], at(6, 29), 0.0), "walked past": ([rail(1)], at(6, 29), 60.0), "first only": ([rail(1), other("TAXI", 4000), rail(1)], at(4, 0), 0.0), "no time": ([rail(1)], None, 0.0),
        "night window": ([bus(1), other("TAXI", 3600), bus(1, "b")], at(20, 0), 0.0), "day window": ([bus(1), other("TAXI", 3600), bus(1, "b")], at(12, 0), 0.0), "no time, no night": ([bus(1), other("TAXI", 3600), bus(1, "b")], None, 0.0),
    })
    assert {k: r.value for k, r in got.items()} == {"early": 1240, "walked past": 1550, "first only": 2790, "no time": 1550, "night window": 1650, "day window": 3300, "no time, no night": 3300}


def test_prices_that_are_not_known(spark):
    got = told(spark, {
        "kind": [bus(1, kind="시외")], "distance": [bus(None)], "negative": [rail(-1)], "line": [rail(1, "신분당선")], "no place": [rail(1, "1호선")], "beyond": [rail(1, "1호선", "수원역", "천안역")], "within": [rail(1, "1호선", "수원역", "의왕")],
        "no route": [("BUS", 1.0, 1.0, 0.0, None, None, None, None, [])], "one choice": [bus(1, more=[("b", "b", "gyeonggi", "시외")])], "unlike first": [bus(1, more=[("b", "b", "seoul", "광역")]), bus(1, "c", kind="시외")],
    })
    want = {"kind": fares.NO_TARIFF, "distance": fares.NO_DISTANCE, "negative": fares.NO_DISTANCE, "line": fares.NO_LINE, "no place": fares.NO_PLACE, "beyond": fares.NO_PLACE, "within": None, "no route": fares.NO_ROUTE, "one choice": fares.NO_TARIFF, "unlike first": fares.UNLIKE}
    assert {k: r.reason for k, r in got.items()} == want
    assert all((r.value, r.source, r.least) == ((9999.0, "fallback", None) if r.reason else (1550.0, "rules_estimate", 1550.0)) for r in got.values())


def test_choices_are_the_product_of_single_routes(spark):
    """Every choice priced as a journey of its own."""
    rng = random.Random(6)
    kinds = [("gyeonggi", "일반"), ("seoul", "간선"), ("gyeonggi", "직행"), ("gyeonggi", "광역"), ("seoul", "마을")]
    journeys, single = {}, {}
    for j in range(40):
        steps = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.3:
                steps.append(other(rng.choice(["TAXI", "WALKING"]), rng.choice([300, 1500, 2000])))
            if rng.random() < 0.3:
                steps.append(rail(rng.choice([3, 12, 31])))
            else:
                options = [(str(rng.randint(0, 3)), "x", *rng.choice(kinds)) for _ in range(rng.randint(1, 3))]
                steps.append(("BUS", rng.choice([2, 9, 24, 41]) * 1000.0, 600.0, rng.choice([0.0, 700.0]), None, None, None, None, options))
        journeys[str(j)] = steps
        choices = [[(*s[:8], [o]) for o in s[8]] if s[8] else [s] for s in steps]
        for n, chosen in enumerate(itertools.product(*choices)):
            single[f"{j}/{n}"] = list(chosen)
    got, each = told(spark, journeys), told(spark, single)
    ranges = 0
    for j, steps in journeys.items():
        mine = [r for k, r in each.items() if k.split("/")[0] == j]
        kept = {r.transfer_kept for r in mine}
        row = got[j]
        assert (row.least, row.greatest, row.value) == (min(r.value for r in mine), max(r.value for r in mine), max(r.value for r in mine))
        assert row.transfer_kept == (kept.pop() if len(kept) == 1 else None)
        assert row.source == ("rules_range" if any(s[8] and len(s[8]) > 1 for s in steps) else "rules_estimate")
        ranges += row.least < row.greatest
    assert ranges > 5


def test_many_choices_stay_few_states(spark):
    """Two alike routes at each of fifteen rides: 32,768 choices, and one result."""
    steps = [bus(2, f"{i}x", more=[(f"{i}y", "y", "gyeonggi", "일반")]) for i in range(15)]
    row = told(spark, {"long": steps})["long"]
    assert (row.least, row.greatest) == (3 * 1650.0, 3 * 1650.0)


@pytest.mark.parametrize("routes, fare", [([["1"], ["1", "2"]], 3000.0), ([["1", "3"], ["2", "4"]], 1500.0)])
def test_sets_of_routes_in_the_fold(spark, routes, fare):
    rides = [("j", i, 36000.0 + 700 * i, 36600.0 + 700 * i, 1.0, 1500.0, 10.0, "flat", 0.0, False, r) for i, r in enumerate(routes)]
    schema = "journey string, pos int, board_s double, alight_s double, km double, base double, free_km double, mode string, early double, taxi boolean, route array<string>"
    assert fares.transfer_fares(spark.createDataFrame(rides, schema)).first().fare == fare


def test_short_journeys_are_folded_in_place(spark, monkeypatch):
    """They take one shuffle and write one table, however many rides they have, and cost what rounds make of them."""
    rng = random.Random(20)
    kinds = [("gyeonggi", "일반"), ("seoul", "간선"), ("gyeonggi", "직행"), ("gyeonggi", "광역"), ("seoul", "마을"), ("seoul", "시외")]
    cases = {"none": ([], DAY, 0.0)}
    for j in range(60):
        steps = []
        for _ in range(rng.randint(1, 8)):
            if rng.random() < 0.4:
                steps.append(other(rng.choice(["TAXI", "WALKING"]), rng.choice([300, 1500, 2000, 3500])))
            options = [(rng.choice(["0", "1", "rail", None]), "x", *rng.choices(kinds, [9, 9, 3, 9, 9, 0.2])[0]) for _ in range(rng.randint(1, 2))]
            steps.append(rail(rng.choice([3, 12, 31, 60])) if rng.random() < 0.4 else ("BUS", rng.choice([2, 9, 24, 90]) * 1000.0, 600.0, rng.choice([0.0, 700.0, None]), None, None, None, None, options))
        cases[str(j)] = (steps, rng.choice([None, DAY, datetime(2026, 9, 23, 5), datetime(2026, 9, 23, 20)]), 60.0)
    written, settled = [], fares.settled
    monkeypatch.setattr(fares, "settled", lambda df, what: written.append(what) or settled(df, what))
    got = told(spark, cases)
    assert written == ["fare-journeys"]
    monkeypatch.setattr(fares, "FOLDED", 1)
    assert told(spark, cases) == got and "fare-states" in written
    assert {r.source for r in got.values()} == {"fallback", "rules_range", "rules_estimate"}
