"""Times and fares of walks, taxis and rides, and what a journey costs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cost model.
WALK_MPS, WALK_DETOUR = 0.83, 1.39
TAXI_COEFFICIENT, TAXI_POWER = 370.0, 0.70
TAXI_BANDS = {"peak": 1.20, "normal": 1.0, "night": 0.84}
TAXI_DETOUR = 1.42
TAXI_PICKUP_S, TAXI_CONNECT_S = 90, 60
TAXI_BASE = 4800
#: Kilometres in the base fare, and won a kilometre beyond, by class.
TAXI_CLASSES = {"표준": (1.6, 100 / 0.131), "가": (1.8, 100 / 0.104), "나": (2.0, 100 / 0.083)}
VALUE_OF_TIME = {"time": 456, "balance": 300, "fare": 150}
MIN_SAVING_S = 300
DEFAULT_WAIT_S = 900

# Surcharges from 22 or 23 to 4 o'clock, kilometres an hour of buses by kind and of trains by line, and what a train's stop costs.
NIGHT_SEOUL, NIGHT_ELSEWHERE = (22, 1.2), (23, 1.3)
NIGHT_END = 4
BUS_KMH = {"마을": 10.0, "순환": 10.0, "지선": 12.0, "일반": 13.0, "간선": 13.0, "심야": 15.0, "광역": 17.0, "직행": 17.0, "시외": 21.0, "공항": 21.0}
BUS_KMH_DEFAULT = 13.0
RAIL_KMH = {"GTX-A": 90.0, "1호선": 46.0, "경의중앙선": 44.0, "신분당선": 38.0, "8호선": 38.0, "수인분당선": 36.0, "4호선": 34.0, "3호선": 34.0, "7호선": 33.0, "2호선": 31.0, "5호선": 30.0, "6호선": 30.0, "9호선": 30.0}
RAIL_KMH_DEFAULT, RAIL_CONNECT_S = 34.0, 120


def walk_s(metres: Column) -> Column:
    return metres * (WALK_DETOUR / WALK_MPS)


def taxi_band(at: Column) -> Column:
    """night from 22 to 6; peak on weekdays from 7 to 10 and 17 to 19:30; else normal, also for no time."""
    minute = F.hour(at) * 60 + F.minute(at)
    peak = (F.weekday(at) < 5) & (((minute >= 420) & (minute < 600)) | ((minute >= 1020) & (minute < 1170)))
    return F.when((minute >= 1320) | (minute < 360), "night").when(peak, "peak").otherwise("normal")


def band_factor(band: Column) -> Column:
    return F.when(band == "night", TAXI_BANDS["night"]).when(band == "peak", TAXI_BANDS["peak"]).otherwise(TAXI_BANDS["normal"])


def taxi_s(metres: Column, band: Column) -> Column:
    return TAXI_COEFFICIENT * F.pow(metres / 1000, F.lit(TAXI_POWER)) * band_factor(band)


def taxi_reach_m(seconds: Column, band: Column) -> Column:
    """How far a taxi gets in a time."""
    return 1000 * F.pow(seconds / (TAXI_COEFFICIENT * band_factor(band)), F.lit(1 / TAXI_POWER))


def walk_equal_m() -> float:
    """The straight distance at which walking takes as long as calling, riding and leaving a taxi by day.

    Walking grows in proportion and the taxi by a lesser power, so a step x -> (calls + taxi(x)) * speed closes in on it.
    """
    x = 0.0
    while True:
        taxi = TAXI_PICKUP_S + TAXI_CONNECT_S + TAXI_COEFFICIENT * (x / 1000) ** TAXI_POWER
        nearer = taxi * WALK_MPS / WALK_DETOUR
        if abs(nearer - x) < 1e-9:
            return nearer
        x = nearer


def taxi_fare(metres: Column, kind: Column, factor: Column) -> Column:
    """The base fare and the steps beyond its distance, times the surcharges, in hundreds of won upward."""
    km = metres * TAXI_DETOUR / 1000
    fare = F.lit(None).cast("double")
    for name, (free, each) in TAXI_CLASSES.items():
        fare = F.when(kind == name, TAXI_BASE + F.greatest(F.lit(0.0), km - free) * each).otherwise(fare)
    return F.ceil(F.round(fare * factor / 100, 6)) * 100


def step_fare(base: Column, free_km: Column, interval_km: Column, km: Column, most: Column | None = None) -> Column:
    """base and 100 won for each interval begun beyond the free distance, the extra capped if most is given."""
    extra = 100 * F.ceil(F.greatest(F.lit(0.0), km - free_km) / interval_km)
    return base + (extra if most is None else F.least(extra, most))


def rail_fare(base: Column, km: Column) -> Column:
    """Steps of 5 km from 10 to 50 km and of 8 km beyond."""
    near = F.ceil(F.greatest(F.lit(0.0), F.least(km, F.lit(50.0)) - 10) / 5)
    far = F.ceil(F.greatest(F.lit(0.0), km - 50) / 8)
    return base + 100 * (near + far)


def generalised_s(time_s: Column, fare: Column, value_of_time: float) -> Column:
    """Seconds, with the fare as time at so many won a minute."""
    return time_s + fare / value_of_time * 60


def saving_per_minute(base_fare: Column, fare: Column, base_s: Column, time_s: Column) -> Column:
    """Won paid for each minute saved; null if none is saved."""
    saved = (base_s - time_s) / 60
    return F.when(saved > 0, (fare - base_fare) / F.when(saved > 0, saved))


def total_s(steps: Column) -> Column:
    """Durations and waits of an array of steps; a wait that isn't known counts 15 minutes, one of 0 counts 0."""
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["time_s"], F.lit(0.0)) + F.coalesce(s["wait_s"], F.when(s["type"] == "ride", float(DEFAULT_WAIT_S)).otherwise(0.0)))


def arrival_s(eta_s: Column, stops_ahead: Column, age: Column, per_stop_s: Column) -> Column:
    """Seconds until a vehicle comes: its own estimate, else by stops, less the age of the report; null once past."""
    left = F.coalesce(eta_s, stops_ahead * per_stop_s) - F.coalesce(age, F.lit(0))
    return F.when(left >= 0, left)


def first_wait_s(arrivals: Column, walk: Column, headway_s: Column) -> Column:
    """The wait for the first arrival that the walk allows, else for one that whole headways after the last bring; null if none is known."""
    known = F.filter(arrivals, lambda a: a.isNotNull())
    caught = F.array_min(F.filter(known, lambda a: a >= walk))
    last = F.array_max(known)
    later = last + F.ceil((walk - last) / headway_s) * headway_s
    return F.coalesce(caught, F.when(headway_s > 0, later)) - walk


def night_factor(seoul: Column, hour: Column) -> Column:
    """The night surcharge by where and when a taxi is boarded; 1 at an unknown hour, outside Seoul if the place isn't known."""
    inside = F.coalesce(seoul, F.lit(False))
    start, factor = (F.when(inside, a).otherwise(b) for a, b in zip(NIGHT_SEOUL, NIGHT_ELSEWHERE))
    return F.when((hour >= start) | (hour < NIGHT_END), factor).otherwise(1.0)


def taxi_plan_s(eta_s: Column, connect: Column) -> Column:
    """Seconds to plan for a taxi: the call, the ride, and a buffer if something is boarded after it."""
    return TAXI_PICKUP_S + F.coalesce(eta_s, F.lit(0)) + F.when(connect, TAXI_CONNECT_S).otherwise(0)


def _looked_up(kmh: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kmh.items() for x in pair]), key), F.lit(default))


def bus_kmh(kind: Column) -> Column:
    return _looked_up(BUS_KMH, kind, BUS_KMH_DEFAULT)


def rail_kmh(line: Column) -> Column:
    return _looked_up(RAIL_KMH, line, RAIL_KMH_DEFAULT)


def rest_s(metres: Column, band: Column) -> Column:
    """The least time that is left over a straight distance: by taxi, or by train with one connection."""
    return F.least(taxi_s(metres, band), metres * 3.6 / RAIL_KMH_DEFAULT + RAIL_CONNECT_S)


def fare_of(value: Column, least: Column) -> Column:
    """The fare, or the least that is possible where it isn't known."""
    return F.coalesce(value, least)
