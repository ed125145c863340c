"""Fares of journeys with transfers: from priced rides, and from steps whose routes may be chosen, by a tariff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from transitlake.functions import costs
from transitlake.plans.storage import settled

# Fixed values of the fare rules: boardings of a group, the distance that a step of 100 won covers, the most that a bus
# adds for its distance, when early journeys end, the transfer windows by day and from 21 to 7 o'clock, an unknown wait.
MAX_BOARDINGS, INTERVAL_M, BUS_CAP, EARLY_S = 5, 5_000.0, 700.0, 6.5 * 3600
WINDOW_S, NIGHT_WINDOW_S, UNKNOWN_WAIT_S = 1_800.0, 3_600.0, 900.0
# Tariffs by who runs a bus and its kind, as base, free metres, how distance is priced, and early discount.
TARIFF = {
    ("seoul", "간선"): (1500, 10000, "flat", 300),
    ("seoul", "지선"): (1500, 10000, "flat", 300),
    ("seoul", "순환"): (1400, 10000, "flat", 280),
    ("seoul", "마을"): (1200, 10000, "flat", 240),
    ("seoul", "광역"): (3000, 30000, "flat", 600),
    ("gyeonggi", "일반"): (1650, 10000, "bus", 200),
    ("gyeonggi", "좌석"): (2650, 30000, "flat", 200),
    ("gyeonggi", "직행"): (3200, 30000, "flat", 400),
    ("gyeonggi", "광역"): (3200, 30000, "bus", 400),
    ("gyeonggi", "순환"): (3450, 30000, "bus", 400),
}
NIGHT_BUS, RAIL = (2500, 10000, "flat", 500), (1550, 10000, "rail", 310)
# Lines of the common rail tariff, the two that leave it, and their stations beyond it.
RAIL_LINES = ("1호선", "2호선", "3호선", "4호선", "5호선", "6호선", "7호선", "8호선", "9호선", "수인분당선", "경의중앙선", "경춘선", "경강선", "서해선", "우이신설선", "신림선", "인천1호선", "인천2호선", "김포골드라인")
LEAVING_LINES = ("1호선", "경춘선")
BEYOND = ("평택", "성환", "직산", "두정", "천안", "봉명", "쌍용", "아산", "탕정", "배방", "온양온천", "신창", "가평", "굴봉산", "백양리", "강촌", "김유정", "남춘천", "춘천")
# Choices of routes in all that a journey has at most to be folded in its row.
FOLDED = 256
# Choices of journeys that a task folds at once, about.
FOLD_ROWS = 100_000
# Why a step has no price.
NO_DISTANCE, NO_LINE, NO_PLACE = "구간 거리 미확인", "철도 별도운임 또는 노선 미확인", "수도권 외 철도 운임거리 미확인"
NO_ROUTE, NO_TARIFF, UNLIKE = "버스 관할·노선 유형 미확인", "마을버스 관할 요금 또는 별도 버스 운임 미확인", "승차 가능 노선의 요금이 서로 다름"


def _fields(**named: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in named.items()])


def _ride(m, base, free_m, mode) -> Column:
    return _fields(m=m, base=base, free_m=free_m, mode=mode)


def _alone(x: Column) -> Column:
    """What a ride costs by itself."""
    bus = costs.step_fare(x["base"], x["free_m"], F.lit(INTERVAL_M), x["m"], F.lit(BUS_CAP))
    return F.when(x["mode"] == "rail", costs.rail_fare(x["base"], x["m"] / 1000)).when(x["mode"] == "bus", bus).otherwise(x["base"])


def _start() -> Column:
    """The state before the first ride."""
    zero = F.lit(0.0)
    return _fields(
        closed=zero, groups=F.lit(0), n=F.lit(0), base=zero, free_m=zero, m=zero, before=zero, last=_ride(zero, zero, zero, F.lit("")), off=zero, paid=zero, until=zero,
        routes=F.array().cast("array<string>"), kept=F.lit(None).cast("boolean"),
    )


def _take(g: Column, r: Column) -> Column:
    """The state after one more ride: board_s, alight_s, clock, m, base, free_m, mode, early, taxi, routes."""
    hour = F.pmod(F.floor(r["board_s"] / 3600), F.lit(24))
    in_time = r["board_s"] - g["until"] <= F.when(r["clock"] & ((hour >= 21) | (hour < 7)), NIGHT_WINDOW_S).otherwise(WINDOW_S)
    both_rail = (g["last"]["mode"] == "rail") & (r["mode"] == "rail")
    any_rail = (g["last"]["mode"] == "rail") | (r["mode"] == "rail")
    inside = (g["n"] > 0) & both_rail & ~r["taxi"]
    same_bus = ~any_rail & F.arrays_overlap(g["routes"], r["routes"])
    joins = inside | ((g["n"] > 0) & (g["n"] < MAX_BOARDINGS) & in_time & ~both_rail & ~F.coalesce(same_bus, F.lit(False)))
    early = r["clock"] & (F.pmod(r["board_s"], F.lit(86400.0)) < EARLY_S)
    # What the group then is; its fare follows from that in a second step.
    now = _fields(
        joins=joins,
        n=F.when(inside, g["n"]).when(joins, g["n"] + 1).otherwise(1),
        base=F.when(inside, g["base"]).when(joins, F.greatest(g["base"], r["base"])).otherwise(r["base"]),
        free_m=F.when(inside, g["free_m"]).when(joins, F.greatest(g["free_m"], r["free_m"])).otherwise(r["free_m"]),
        m=F.when(joins, g["m"] + r["m"]).otherwise(r["m"]),
        before=F.when(inside, g["before"]).when(joins, g["before"] + _alone(g["last"])).otherwise(0.0),
        last=F.when(inside, _ride(g["last"]["m"] + r["m"], g["last"]["base"], g["last"]["free_m"], g["last"]["mode"])).otherwise(_ride(r["m"], r["base"], r["free_m"], r["mode"])),
        off=F.when(joins, g["off"]).when((g["groups"] == 0) & early, r["early"]).otherwise(0.0),
    )

    def settle(x: Column) -> Column:
        singly = x["before"] + _alone(x["last"])
        together = costs.step_fare(x["base"], x["free_m"], F.lit(INTERVAL_M), x["m"])
        owed = F.when(x["n"] == 1, singly).otherwise(F.least(together, singly)) - x["off"]
        least = F.when(x["joins"], g["paid"] + F.greatest(F.lit(0.0), x["base"] - g["base"])).otherwise(0.0)
        return _fields(
            closed=F.when(x["joins"], g["closed"]).otherwise(g["closed"] + g["paid"]),
            groups=g["groups"] + F.when(x["joins"], 0).otherwise(1),
            n=x["n"], base=x["base"], free_m=x["free_m"], m=x["m"], before=x["before"], last=x["last"], off=x["off"],
            paid=F.greatest(least, owed), until=r["alight_s"], routes=r["routes"],
            kept=F.when(r["taxi"] & (g["n"] > 0), x["joins"]).otherwise(g["kept"]),
        )

    return F.transform(F.array(now), settle)[0]


def transfer_fares(rides: DataFrame, key: str = "journey") -> DataFrame:
    """fare and groups of journeys of rides(key, pos, board_s, alight_s, km, base, free_km, mode, early, taxi, route).

    mode is rail, bus or flat; early is the discount of a journey begun before 6:30; taxi says if one was taken since
    the ride before. Rides within the transfer window of the last form a group of up to five, but not two in a row on
    one bus route; a train of that name is another route. Rail after rail without a taxi goes on within the gates as
    the same ride, at the base it began with. A group pays its dearest base and 100 won for each 5 km begun beyond its
    longest free distance, but not more than its rides would singly. What is paid is never given back: a dearer base is
    paid on top of it. route is one name or an array of those that could have been boarded.
    """
    routes = F.col("route") if rides.schema["route"].dataType.typeName() == "array" else F.array("route")
    metres = lambda c: F.round(F.col(c) * 1000, 6)
    columns = [F.col("pos"), F.col("board_s"), F.col("alight_s"), F.lit(True).alias("clock"), metres("km").alias("m"), F.col("base"), metres("free_km").alias("free_m"), F.col("mode"), F.col("early"), F.col("taxi"), routes.alias("routes")]
    journeys = rides.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rides"))
    return journeys.withColumn("g", F.aggregate("rides", _start(), _take)).select(key, (F.col("g.closed") + F.col("g.paid")).alias("fare"), F.col("g.groups").alias("groups"))


def _rule(of: tuple) -> Column:
    base, free, mode, early = of
    return _fields(base=F.lit(float(base)), free_m=F.lit(float(free)), mode=F.lit(mode), early=F.lit(float(early)))


def route_rule(route: Column) -> Column:
    """The tariff of a bus route(id, name, source, type), null if it has none; the night buses of Seoul begin with N."""
    known = F.create_map(*[x for (source, kind), of in TARIFF.items() for x in (F.lit(f"{source}/{kind}"), _rule(of))])
    night = (route["source"] == "seoul") & F.coalesce(route["name"].startswith("N"), F.lit(False))
    return F.when(night, _rule(NIGHT_BUS)).otherwise(F.try_element_at(known, F.concat_ws("/", route["source"], route["type"])))


def resolved(rides: DataFrame) -> DataFrame:
    """rides(type BUS or SUBWAY, distance_m, line_group, board_name, alight_name, stops, fare_routes) with options, one a route that could be boarded, each with its rule, and reason, why the whole step has no one price, or null."""
    rail = F.col("type") == "SUBWAY"
    names = F.filter(F.concat(F.coalesce("stops", F.array().cast("array<string>")), F.array("board_name", "alight_name")), lambda n: n.isNotNull())
    beyond = F.exists(names, lambda n: F.regexp_replace(n, "역$", "").isin(*BEYOND))
    routes = F.coalesce("fare_routes", F.array().cast(rides.schema["fare_routes"].dataType))
    one = F.array(_fields(routes=F.array(F.lit("rail")), rule=_rule(RAIL)))
    out = rides.withColumn("options", F.when(rail, one).otherwise(F.transform(routes, lambda r: _fields(routes=F.array(r["id"].cast("string")), rule=route_rule(r)))))
    reason = (
        F.when(F.col("distance_m").isNull() | F.isnan("distance_m") | (F.abs("distance_m") == float("inf")) | (F.col("distance_m") < 0), NO_DISTANCE)
        .when(rail & ~F.coalesce(F.col("line_group").isin(*RAIL_LINES), F.lit(False)), NO_LINE)
        .when(rail & F.col("line_group").isin(*LEAVING_LINES) & ((F.size(names) == 0) | beyond), NO_PLACE)
        .when(~rail & (F.size("options") == 0), NO_ROUTE)
        .when(~rail & F.exists("options", lambda o: o["rule"].isNull()), NO_TARIFF)
        .when(~rail & (F.size(F.array_distinct(F.transform("options", lambda o: o["rule"]))) > 1), UNLIKE)
    )
    return out.withColumn("reason", reason)


def fare_options(journeys: DataFrame, steps: DataFrame, key: str = "journey") -> DataFrame:
    """What journeys cost by the tariff over all choices of their routes: key, value, least, greatest, source, reason, transfer_kept.

    journeys(key, fallback, at, initial_walk_s); steps(key, pos, type, distance_m, time_s, wait_s, line_group, board_name,
    alight_name, stops, fare_routes array<struct<id,name,source,type>>). Walks, waits, 15 minutes where not known, and
    taxis count towards the transfer window only; without a time nothing is early and the window that of the day. value
    is greatest, the dearest choice. If a step of some choice has no price, value is fallback, with the first step's
    reason. source is rules_estimate, rules_range if a bus could be chosen, or fallback; transfer_kept says if the ride
    after the last taxi went on as a transfer, null if no taxi lay between or choices differ. No rides cost nothing.

    Steps are shuffled by journey once and written a row a journey; those of up to FOLDED choices are then folded in
    place, many rows at once (see _folded). Those of more go by rounds (see _by_rounds).
    """
    along = Window.partitionBy(key).orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    is_ride = F.col("type").isin("BUS", "SUBWAY")
    wait = F.when(is_ride, F.coalesce("wait_s", F.lit(UNKNOWN_WAIT_S))).otherwise(0.0)
    timed = journeys.select(key, "fallback", "at", F.coalesce("initial_walk_s", F.lit(0.0)).cast("double").alias("_walk")).join(steps, key, "left").withColumns(
        {"_wait": wait, "_ride": F.coalesce(is_ride, F.lit(False)), "_time": F.coalesce(F.col("time_s").cast("double"), F.lit(0.0))}
    )
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    clock = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")
    board = F.coalesce(clock, F.lit(0)) + F.col("_walk") + F.coalesce(F.sum(F.col("_time") + F.col("_wait")).over(before), F.lit(0.0)) + F.col("_wait")
    timed = timed.withColumns({"board_s": board, "seq": so_far(F.col("_ride").cast("int")), "_taxis": so_far((F.col("type") == "TAXI").cast("int"))})
    taxi = F.col("_taxis") > F.coalesce(F.last(F.when(F.col("_ride"), F.col("_taxis")), True).over(before), F.lit(0))
    timed = resolved(timed.withColumn("taxi", taxi))
    ride = _fields(seq=F.col("seq"), board_s=F.col("board_s"), alight_s=F.col("board_s") + F.col("_time"), clock=F.col("at").isNotNull(), m=F.col("distance_m").cast("double"), taxi=F.col("taxi"), options=F.col("options"), reason=F.col("reason"))
    rides = timed.groupBy(key).agg(F.first("fallback").alias("fallback"), F.array_sort(F.collect_list(F.when(F.col("_ride"), ride))).alias("rides"))
    unpriced = F.exists("rides", lambda r: F.coalesce(r["reason"] != UNLIKE, F.lit(False)))
    choices = F.aggregate("rides", F.lit(1.0), lambda n, r: n * F.size(r["options"]))
    reason = F.filter("rides", lambda r: r["reason"].isNotNull())[0]["reason"]
    choice = F.exists("rides", lambda r: F.size(r["options"]) > 1)
    told = rides.withColumns({"unpriced": unpriced, "choices": choices}).select(key, F.col("fallback").cast("double").alias("fallback"), "unpriced", "choices", F.when(F.col("unpriced"), reason).alias("reason"), choice.alias("choice"), F.when(~F.col("unpriced"), F.col("rides")).alias("rides"))
    told = settled(told, "fare-journeys")
    few, many, none = told.filter(f"not unpriced and choices <= {FOLDED}"), told.filter(f"not unpriced and choices > {FOLDED}"), told.filter("unpriced")
    schema = T.StructType([told.schema[key], told.schema["choice"], *[T.StructField(c, T.DoubleType()) for c in ("least", "greatest")], T.StructField("transfer_kept", T.BooleanType())])
    every = few.select(key, "choice", "choices", "rides").mapInArrow(_folded, schema)
    if not many.isEmpty():
        every = every.unionByName(many.select(key, "choice").join(_by_rounds(many, key), key))
    source = F.when(F.col("choice"), "rules_range").otherwise("rules_estimate")
    priced = every.select(key, F.col("greatest").alias("value"), "least", "greatest", source.alias("source"), F.lit(None).cast("string").alias("reason"), "transfer_kept")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return priced.unionByName(none.select(key, F.col("fallback").alias("value"), null("least", "double"), null("greatest", "double"), F.lit("fallback").alias("source"), "reason", null("transfer_kept", "boolean")))


def _alone_rows(m, base, free_m, mode):
    """_alone of arrays."""
    km = m / 1000
    rail = 100 * (np.ceil(np.maximum(0.0, np.minimum(km, 50.0) - 10) / 5) + np.ceil(np.maximum(0.0, km - 50) / 8))
    bus = np.minimum(100 * np.ceil(np.maximum(0.0, m - free_m) / INTERVAL_M), BUS_CAP)
    return base + np.where(mode == "rail", rail, np.where(mode == "bus", bus, 0.0))


def _take_rows(g: dict, r: dict) -> dict:
    """_take of arrays, a state and a ride each; a ride has one route, a number or -1, and last is told apart into its parts."""
    hour = np.floor(r["board_s"] / 3600) % 24
    in_time = r["board_s"] - g["until"] <= np.where(r["clock"] & ((hour >= 21) | (hour < 7)), NIGHT_WINDOW_S, WINDOW_S)
    was_rail, is_rail, any_before = g["last_mode"] == "rail", r["mode"] == "rail", g["n"] > 0
    inside = any_before & was_rail & is_rail & ~r["taxi"]
    same_bus = ~was_rail & ~is_rail & (g["route"] == r["route"]) & (r["route"] >= 0)
    joins = inside | (any_before & (g["n"] < MAX_BOARDINGS) & in_time & ~(was_rail & is_rail) & ~same_bus)
    early = r["clock"] & (r["board_s"] % 86400.0 < EARLY_S)
    pick = lambda one, two, three: np.where(inside, one, np.where(joins, two, three))
    x = {
        "n": pick(g["n"], g["n"] + 1, 1), "base": pick(g["base"], np.maximum(g["base"], r["base"]), r["base"]), "free_m": pick(g["free_m"], np.maximum(g["free_m"], r["free_m"]), r["free_m"]),
        "m": np.where(joins, g["m"] + r["m"], r["m"]), "before": pick(g["before"], g["before"] + _alone_rows(*[g[f"last_{c}"] for c in ("m", "base", "free_m", "mode")]), 0.0),
        "last_m": np.where(inside, g["last_m"] + r["m"], r["m"]), **{f"last_{c}": np.where(inside, g[f"last_{c}"], r[c]) for c in ("base", "free_m", "mode")},
        "off": np.where(joins, g["off"], np.where((g["groups"] == 0) & early, r["early"], 0.0)),
    }
    singly = x["before"] + _alone_rows(*[x[f"last_{c}"] for c in ("m", "base", "free_m", "mode")])
    together = x["base"] + 100 * np.ceil(np.maximum(0.0, x["m"] - x["free_m"]) / INTERVAL_M)
    owed = np.where(x["n"] == 1, singly, np.minimum(together, singly)) - x["off"]
    least = np.where(joins, g["paid"] + np.maximum(0.0, x["base"] - g["base"]), 0.0)
    return x | {
        "closed": np.where(joins, g["closed"], g["closed"] + g["paid"]), "groups": g["groups"] + ~joins, "paid": np.maximum(least, owed), "until": r["alight_s"], "route": r["route"],
        "kept": np.where(r["taxi"] & any_before, joins, g["kept"]),
    }


def _fold_rows(rides: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """least, greatest and kept, -1 if none or several, of journeys over all choices, a ride of all of them at a time."""
    plain = lambda a: a.to_numpy(zero_copy_only=False)
    size, ride = plain(rides.value_lengths()).astype(np.int64), rides.flatten()
    options = ride.field("options")
    many, option = plain(options.value_lengths()).astype(np.int64), options.flatten()
    first_ride, first_option = np.cumsum(size) - size, np.cumsum(many) - many
    by_ride = {c: plain(ride.field(c)) for c in ("board_s", "alight_s", "clock", "m", "taxi")}
    by_option = {c: plain(option.field("rule").field(c)) for c in ("base", "free_m", "early")}
    by_option["mode"] = plain(option.field("rule").field("mode")).astype("U4")
    by_option["route"] = plain(option.field("routes").flatten().dictionary_encode().indices.cast(pa.int64()).fill_null(-1))
    least, greatest, low, high = np.full(len(size), np.inf), np.full(len(size), -np.inf), np.full(len(size), 2), np.full(len(size), -2)
    of, n = np.arange(len(size)), 0
    g = {c: np.zeros(len(of)) for c in ("closed", "base", "free_m", "m", "before", "last_m", "last_base", "last_free_m", "off", "paid", "until")}
    g |= {"groups": np.zeros(len(of), np.int64), "n": np.zeros(len(of), np.int64), "last_mode": np.full(len(of), "", "U4"), "route": np.full(len(of), -1), "kept": np.full(len(of), -1)}
    while True:
        ended = size[of] == n
        at, cost, kept = of[ended], (g["closed"] + g["paid"])[ended], g["kept"][ended]
        np.minimum.at(least, at, cost), np.maximum.at(greatest, at, cost), np.minimum.at(low, at, kept), np.maximum.at(high, at, kept)
        of, g = of[~ended], {c: v[~ended] for c, v in g.items()}
        if not len(of):
            return least, greatest, np.where(low == high, low, -1)
        r = first_ride[of] + n
        each = np.repeat(np.arange(len(of)), many[r])
        o = first_option[r][each] + np.arange(len(each)) - (np.cumsum(many[r]) - many[r])[each]
        of, g = of[each], _take_rows({c: v[each] for c, v in g.items()}, {c: v[r][each] for c, v in by_ride.items()} | {c: v[o] for c, v in by_option.items()})
        n += 1


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, choice, least, greatest, transfer_kept of rows of key, choice, choices and rides, as many at once as have FOLD_ROWS choices or few more."""
    for batch in batches:
        block = (np.cumsum(batch.column(2).to_numpy()) // FOLD_ROWS).astype(np.int64)
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            some = batch.slice(a, b - a)
            least, greatest, kept = _fold_rows(some.column(3))
            found = [pa.array(least), pa.array(greatest), pa.array(kept == 1, mask=kept < 0)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *found], [*batch.schema.names[:2], "least", "greatest", "transfer_kept"])


def _chosen(r: Column, o: Column) -> Column:
    """A ride by one of its options, as _take wants it."""
    return _fields(**{c: r[c] for c in ("board_s", "alight_s", "clock", "m", "taxi")}, **{c: o["rule"][c] for c in ("base", "free_m", "mode", "early")}, routes=o["routes"])


def _by_rounds(journeys: DataFrame, key: str) -> DataFrame:
    """key, least, greatest, transfer_kept of journeys(key, rides), unfolded a ride at a time for all of them.

    Choices that lead to the same state are one from there on, with the least and the greatest paid before, so what
    grows is the states and not the product of choices.
    """
    r = F.col("ride")
    options = journeys.select(key, F.explode("rides").alias("ride")).select(key, r["seq"].alias("seq"), "ride", F.explode(r["options"]).alias("o"))
    options = settled(options.select(key, "seq", _chosen(r, F.col("o")).alias("r")), "fare-options")
    state = journeys.select(key, (F.size("rides") - 1).alias("last"), _start().alias("g"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    done, n = None, 0
    while True:
        step = state.join(options.filter(F.col("seq") == n).select(key, "r"), key).withColumn("next", _take(F.col("g"), F.col("r")))
        # What is paid for good differs between choices; all else makes up the state.
        now = step.select(key, "last", F.col("next").withField("closed", F.lit(0.0)).alias("g"), *[(F.col(c) + F.col("next.closed")).alias(c) for c in ("low", "high")])
        now = settled(now.groupBy(key, "last", "g").agg(F.min("low").alias("low"), F.max("high").alias("high")), "fare-states")
        ended = now.filter(F.col("last") == n)
        done = ended if done is None else done.unionByName(ended)
        state, n = now.filter(F.col("last") > n), n + 1
        if state.isEmpty():
            break
    kept = F.when(F.count_distinct(F.coalesce(F.col("g.kept").cast("string"), F.lit("none"))) == 1, F.max("g.kept"))
    return done.groupBy(key).agg(F.min(F.col("low") + F.col("g.paid")).alias("least"), F.max(F.col("high") + F.col("g.paid")).alias("greatest"), kept.alias("transfer_kept"))
