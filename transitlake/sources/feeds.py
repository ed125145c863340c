"""Normal forms of route answers, live arrivals and place searches, from JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions import geo, names, times

ITEM = ("source", "route_id", "route_name", "eta_s", "n_stops_ahead", "crowding", "seats", "is_last", "vehicle", "message", "dest")
# Fixed values of the feeds: codes of an arriving and of a preceding train.
ARRIVING, ONE_BEFORE = ("0", "1"), ("3", "4", "5")


def nested(v: Column, name: str, kind: str) -> Column:
    """A field that stands under properties or beside them."""
    return F.coalesce(F.try_variant_get(v, f"$.properties.{name}", kind), F.try_variant_get(v, f"$.{name}", kind))


def text(v: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def whole(v: Column, path: str) -> Column:
    return names.tolerant_number(F.try_variant_get(v, path, "string"), "long")


def rows_of(v: Column, path: str) -> Column:
    """An array, or a single object as an array of one; empty for anything else."""
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(many, F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)), F.array().cast("array<variant>"))


def points(path: Column) -> Column:
    """Pairs, {x, y} objects or a flat list of numbers, under points or bare, as an array of (lon, lat)."""
    raw = F.coalesce(F.try_variant_get(path, "$.points", "array<variant>"), F.try_variant_get(path, "$", "array<variant>"))
    number = lambda v, p: F.try_variant_get(v, p, "double")
    flat = (F.size(raw) > 0) & F.forall(raw, lambda v: number(v, "$").isNotNull())
    some = F.when(F.size(raw) >= 2, F.sequence(F.lit(0), F.floor(F.size(raw) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    by_two = F.transform(some, lambda i: F.struct(number(F.get(raw, i * 2), "$").alias("lon"), number(F.get(raw, i * 2 + 1), "$").alias("lat")))
    each = F.transform(raw, lambda v: F.struct(F.coalesce(number(v, "$.x"), number(v, "$[0]")).alias("lon"), F.coalesce(number(v, "$.y"), number(v, "$[1]")).alias("lat")))
    kept = F.filter(F.when(flat, by_two).otherwise(each), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<lon: double, lat: double>>"))


def without_repeats(path: Column) -> Column:
    """A path without vertices that repeat the one before."""
    return F.filter(path, lambda p, i: (i == 0) | (p != F.get(path, i - 1)))


def transit_steps(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """A row for each step of each route of JSON answers, with the names where one boards and alights."""
    parsed = answers.select(key, F.posexplode(rows_of(F.try_parse_json(body), "$.routes")).alias("route", "r"))
    fare = lambda k: names.tolerant_number(F.coalesce(F.try_variant_get("r", f"$.properties.fare.{k}", "string"), F.try_variant_get("r", f"$.fare.{k}", "string")))
    routes = parsed.select(key, "route", fare("value").alias("fare"), fare("min").alias("fare_min"), names.tolerant_number(nested(F.col("r"), "totalTime", "string")).alias("total_s"), F.posexplode(F.coalesce(nested(F.col("r"), "steps", "array<variant>"), F.array().cast("array<variant>"))).alias("step", "s"))
    s = F.col("s")
    named = F.transform(F.coalesce(nested(s, "stops", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    stops = F.filter(named, lambda n: n.isNotNull() & (n != ""))
    start, end = names.guidance(nested(s, "guidance", "string"))
    return routes.withColumn("stops", stops).select(
        key, "route", F.coalesce("fare", "fare_min").alias("fare"), "total_s", "step",
        nested(s, "type", "string").alias("type"),
        names.tolerant_number(nested(s, "distance", "string")).alias("distance_m"),
        names.tolerant_number(nested(s, "time", "string")).alias("time_s"),
        F.transform(F.coalesce(nested(s, "vehicles", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.struct(F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.name", "string").alias("name"))).alias("vehicles"),
        "stops",
        F.coalesce(F.get("stops", 0), start).alias("board"),
        F.coalesce(F.when(F.size("stops") >= 2, F.element_at("stops", -1)), end).alias("alight"),
        points(nested(s, "path", "variant")).alias("path"),
    )


def car_routes(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Code, distance, time, fares and path of the first route of JSON answers; a failed route has an empty path."""
    r = F.try_variant_get(F.try_parse_json(body), "$.routes[0]", "variant")
    number = lambda p: names.tolerant_number(F.try_variant_get(r, p, "string"))
    roads = F.flatten(F.transform(rows_of(r, "$.sections"), lambda s: rows_of(s, "$.roads")))
    path = without_repeats(F.flatten(F.transform(roads, lambda x: points(F.try_variant_get(x, "$.vertexes", "variant")))))
    code = number("$.result_code").cast("int")
    return answers.select(key, code.alias("result_code"), number("$.summary.distance").alias("distance_m"), number("$.summary.duration").alias("duration_s"), number("$.summary.fare.taxi").alias("taxi_fare"), number("$.summary.fare.toll").alias("toll"), F.when(code == 0, path).otherwise(F.array().cast("array<struct<lon: double, lat: double>>")).alias("path"))


def _two_vehicles(rows: DataFrame, key: str, item) -> DataFrame:
    """The first vehicle of each row, and the second where its time is known."""
    both = rows.select(key, F.explode(F.array(F.struct(F.lit(1).alias("n"), *item(1)), F.struct(F.lit(2).alias("n"), *item(2)))).alias("i")).select(key, "i.*")
    return both.filter("n = 1 or eta_s is not null").select(key, *ITEM)


def gyeonggi_arrivals(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Items of answers with result code 0; one with code 4 has none, any other fails the job."""
    v = F.try_parse_json(body)
    code = F.try_variant_get(v, "$.response.msgHeader.resultCode", "int")
    known = answers.withColumn("_v", v).filter(F.when(code.isin(0, 4), True).otherwise(F.raise_error(F.lit("the feed reports an error")).cast("boolean")))
    rows = known.select(key, F.explode(rows_of(F.col("_v"), "$.response.msgBody.busArrivalList")).alias("r"))
    r = F.col("r")

    def item(n: int) -> list[Column]:
        crowd, seats = whole(r, f"$.crowded{n}").cast("int"), whole(r, f"$.remainSeatCnt{n}").cast("int")
        eta = F.coalesce(whole(r, f"$.predictTimeSec{n}"), whole(r, f"$.predictTime{n}") * 60)
        return [
            F.lit("gyeonggi").alias("source"), text(r, "$.routeId").alias("route_id"), text(r, "$.routeName").alias("route_name"), eta.alias("eta_s"), whole(r, f"$.locationNo{n}").cast("int").alias("n_stops_ahead"),
            F.when(crowd.between(1, 4), crowd).alias("crowding"), F.when(seats > 0, seats).alias("seats"), F.lit(None).cast("boolean").alias("is_last"), text(r, f"$.plateNo{n}").alias("vehicle"),
            F.when(eta.isNull(), "도착 정보가 없습니다.").alias("message"), text(r, "$.routeDestName").alias("dest"),
        ]

    return _two_vehicles(rows, key, item)


def seoul_arrivals(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Items of answers with header code 0. No seconds mean no estimate, unless the message says that the bus is about to come."""
    v = F.try_parse_json(body)
    known = answers.withColumn("_v", v).filter(F.when(F.try_variant_get(v, "$.msgHeader.headerCd", "string") == "0", True).otherwise(F.raise_error(F.lit("the feed reports an error")).cast("boolean")))
    rows = known.select(key, F.explode(rows_of(F.col("_v"), "$.msgBody.itemList")).alias("r"))
    r = F.col("r")

    def item(n: int) -> list[Column]:
        message, seconds, last = text(r, f"$.arrmsg{n}"), whole(r, f"$.traTime{n}"), text(r, f"$.isLast{n}")
        eta = F.when(seconds > 0, seconds).when(message.contains("곧 도착"), F.lit(0).cast("long"))
        return [
            F.lit("seoul").alias("source"), text(r, "$.busRouteId").alias("route_id"), text(r, "$.rtNm").alias("route_name"), eta.alias("eta_s"), names.stops_ahead(message).alias("n_stops_ahead"),
            F.lit(None).cast("int").alias("crowding"), F.lit(None).cast("int").alias("seats"), F.when(last.isin("0", "1"), last == "1").alias("is_last"), text(r, f"$.plainNo{n}").alias("vehicle"),
            message.alias("message"), F.lit(None).cast("string").alias("dest"),
        ]

    return _two_vehicles(rows, key, item)


def incheon_arrivals(rows: DataFrame, key: str) -> DataFrame:
    """Items of rows of text columns, a vehicle each; 255 stands for what isn't told."""
    n = lambda c: names.tolerant_number(F.col(c), "int")
    eta = F.when(n("ARRIVALESTIMATETIME") >= 0, n("ARRIVALESTIMATETIME").cast("long"))
    return rows.select(
        key, F.lit("incheon").alias("source"), F.nullif("ROUTEID", F.lit("")).alias("route_id"), F.lit(None).cast("string").alias("route_name"), eta.alias("eta_s"), F.when(n("REST_STOP_COUNT") >= 0, n("REST_STOP_COUNT")).alias("n_stops_ahead"),
        F.when(n("CONGESTION").between(1, 3), n("CONGESTION")).alias("crowding"), F.when(n("REMAIND_SEAT").between(0, 254), n("REMAIND_SEAT")).alias("seats"), F.when(F.col("LASTBUSYN").isin("0", "1"), F.col("LASTBUSYN") == "1").alias("is_last"),
        F.nullif("BUS_NUM_PLATE", F.lit("")).alias("vehicle"), F.when(eta.isNull(), "도착 정보가 없습니다.").alias("message"), F.lit(None).cast("string").alias("dest"),
    )


def rail_arrivals(answers: DataFrame, key: str, now: Column, body: str = "body") -> DataFrame:
    """Trains of JSON answers. A time counts from its receipt and is unknown once past; a time of 0 means now only with a code of arrival."""
    rows = answers.select(key, now.alias("_now"), F.explode(rows_of(F.try_parse_json(body), "$.realtimeArrivalList")).alias("r"))
    r = F.col("r")
    message, code, left = text(r, "$.arvlMsg2"), text(r, "$.arvlCd"), whole(r, "$.barvlDt")
    age = times.age_s(F.col("_now"), F.try_to_timestamp(text(r, "$.recptnDt")))
    ahead = names.stops_ahead(message)
    run = left - F.coalesce(age, F.lit(0))
    eta = F.when(F.coalesce(left, F.lit(0)) != 0, F.when(run >= 0, run)).when(code.isin(*ARRIVING) & ~(F.coalesce(ahead, F.lit(0)) > 0), F.lit(0).cast("long"))
    return rows.select(
        key, text(r, "$.subwayId").alias("line_id"), text(r, "$.updnLine").alias("direction"), eta.alias("eta_s"), age.alias("age_s"), F.coalesce(ahead, F.when(code.isin(*ONE_BEFORE), 1)).alias("n_stops_ahead"),
        message.alias("message"), text(r, "$.btrainSttus").alias("train_type"), text(r, "$.bstatnNm").alias("dest"), text(r, "$.trainLineNm").alias("headsign"), F.coalesce(text(r, "$.btrainNo"), text(r, "$.trainNo")).alias("train_no"),
    )


def places(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Named places of JSON answers with sound coordinates, in their order."""
    rows = answers.select(key, F.posexplode(rows_of(F.try_parse_json(body), "$.documents")).alias("i", "d"))
    d = F.col("d")
    lon, lat = (names.tolerant_number(F.try_variant_get(d, f"$.{c}", "string")) for c in "xy")
    out = rows.select(key, "i", text(d, "$.place_name").alias("name"), names.last_category(text(d, "$.category_group_name"), F.coalesce(text(d, "$.category_name"), F.lit(""))).alias("detail"), F.coalesce(text(d, "$.road_address_name"), text(d, "$.address_name")).alias("address"), lon.alias("lon"), lat.alias("lat"))
    return out.filter(F.col("name").isNotNull() & geo.in_box(F.col("lon"), F.col("lat")))


def reverse_address(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """The first road address of the first document that has any, else its lot address."""
    docs = rows_of(F.try_parse_json(body), "$.documents")
    found = F.transform(docs, lambda d: F.coalesce(text(d, "$.road_address.address_name"), text(d, "$.address.address_name")))
    return answers.select(key, F.coalesce(F.get(F.filter(found, lambda a: a.isNotNull()), 0), F.lit("")).alias("address"))
