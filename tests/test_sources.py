"""Readers and normal forms on hand-made inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transitlake.sources import feeds, readers


def bodies(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, body string")


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,값\n강남,\n시청,01\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "이름,값\n강남,\n시청,01\n".encode())
    for path, encoding in (("a.csv", "MS949"), ("b.csv", "UTF-8")):
        df = readers.read_csv(spark, f"file://{tmp_path}/{path}", encoding=encoding)
        assert df.columns == ["이름", "값"] and sorted(map(tuple, df.collect())) == [("강남", ""), ("시청", "01")]


def test_record_marks(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ID|NAME^1|가\n나^2|^")
    assert sorted(map(tuple, readers.read_records(spark, f"file://{tmp_path}/r.txt", ["ID", "NAME"]).collect())) == [("1", "가나"), ("2", "")]


def test_geojson(spark, tmp_path):
    ring = [[127, 37], [128, 37], [128, 38], [127, 37]]
    features = [{"properties": {"sgg": "11"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"sgg": "12"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring, ring], [ring]]}}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {r.sgg: r.rings for r in readers.read_geojson(spark, f"file://{tmp_path}/g.json", ["sgg"]).collect()}
    assert [len(rows["11"]), len(rows["12"])] == [1, 3] and rows["11"][0][1].lon == 128.0


def test_stop_times(spark, tmp_path):
    (tmp_path / "s.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nR1_Ord001,05:00:00,05:00:00,S,1,0,0\nR2_Ord001,24:10:00,24:10:00,S,1,1,0\n")
    routes = spark.createDataFrame([("R1",)], "route_id string")
    assert [r.route_id for r in readers.read_stop_times(spark, f"file://{tmp_path}/s.txt", routes).collect()] == ["R1"]


def test_xml_pages(spark):
    page = lambda total, *ids: f"<response><body><items>{''.join(f'<item><ID>{i}</ID></item>' for i in ids)}</items><totalCount>{total}</totalCount><numOfRows>2</numOfRows><pageNo>1</pageNo></body></response>"
    good = spark.createDataFrame([(page(2, "01", "02"),)], "body string")
    assert sorted(r.ID for r in readers.parse_pages(good, "ID: string").collect()) == ["01", "02"]
    with pytest.raises(Exception, match="incomplete"):
        readers.parse_pages(spark.createDataFrame([(page(5, "01"),)], "body string"), "ID: string").collect()


def test_files(spark):
    df = spark.createDataFrame([("/a/route20250101V2.txt",), ("/b/route20250301V2.txt",), ("/a/station20250201V2.txt",)], "path string")
    assert {r.kind: r.path for r in readers.latest_version(df).collect()} == {"route": "/b/route20250301V2.txt", "station": "/a/station20250201V2.txt"}
    assert str(df.select(readers.file_date(F.col("path")).alias("d")).orderBy("d").first().d) == "2025-01-01"


def test_transit_steps(spark):
    step = {"properties": {"type": "BUS", "guidance": "7 (가 > 나)", "time": "600", "vehicles": [{"type": "BUS", "name": "7"}]}, "path": {"points": [[127.0, 37.0], [127.1, 37.1]]}}
    rail = {"type": "SUBWAY", "time": None, "stops": [{"name": "A"}, "", "B"], "path": [127.0, 37.0, 127.2, 37.2, 9.0]}
    rows = feeds.transit_steps(bodies(spark, {"routes": [{"properties": {"totalTime": 900, "fare": {"min": "1500"}}, "steps": [step, rail]}]}, {"status": "none"}), "k").orderBy("step").collect()
    assert [(r.type, r.board, r.alight, r.time_s, r.fare, len(r.path)) for r in rows] == [("BUS", "가", "나", 600.0, 1500.0, 2), ("SUBWAY", "A", "B", None, 1500.0, 2)]


def test_car_routes(spark):
    ok = {"routes": [{"result_code": 0, "summary": {"distance": 10, "duration": 20, "fare": {"taxi": 4800, "toll": 0}}, "sections": [{"roads": [{"vertexes": [1, 2, 3, 4]}, {"vertexes": [3, 4, 5, 6]}]}]}]}
    got = {r.k: (r.result_code, r.taxi_fare, [tuple(p) for p in r.path]) for r in feeds.car_routes(bodies(spark, ok, {"routes": [{"result_code": 104}]}, {}), "k").collect()}
    assert got == {0: (0, 4800.0, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]), 1: (104, None, []), 2: (None, None, [])}


def test_bus_feeds(spark):
    one = {"routeId": 7, "routeName": "7", "predictTimeSec1": 0, "predictTime2": "3", "crowded1": 0, "remainSeatCnt1": 5, "locationNo1": 2, "plateNo1": ""}
    gg = feeds.gyeonggi_arrivals(bodies(spark, {"response": {"msgHeader": {"resultCode": 0}, "msgBody": {"busArrivalList": one}}}, {"response": {"msgHeader": {"resultCode": 4}}}), "k").collect()
    assert sorted((r.k, r.route_id, r.eta_s, r.crowding, r.seats, r.n_stops_ahead) for r in gg) == [(0, "7", 0, None, 5, 2), (0, "7", 180, None, None, None)]
    row = {"busRouteId": "9", "rtNm": "9", "arrmsg1": "곧 도착", "traTime1": "0", "arrmsg2": "12분후[5번째 전]", "traTime2": "720", "isLast1": "1"}
    se = feeds.seoul_arrivals(bodies(spark, {"msgHeader": {"headerCd": "0"}, "msgBody": {"itemList": [row, {"busRouteId": "8", "arrmsg1": "운행종료", "traTime1": "0"}]}}), "k").collect()
    assert sorted((r.route_id, r.eta_s, r.n_stops_ahead, r.is_last) for r in se if r.eta_s is not None) == [("9", 0, None, True), ("9", 720, 5, None)]
    assert [r.message for r in se if r.eta_s is None] == ["운행종료"]
    with pytest.raises(Exception, match="error"):
        feeds.seoul_arrivals(bodies(spark, {"msgHeader": {"headerCd": "7"}}), "k").collect()
    ic = spark.createDataFrame([(1, "R", "-1", "3", "255", "2", "0", "")], "k int, ROUTEID string, ARRIVALESTIMATETIME string, REST_STOP_COUNT string, REMAIND_SEAT string, CONGESTION string, LASTBUSYN string, BUS_NUM_PLATE string")
    r = feeds.incheon_arrivals(ic, "k").first()
    assert (r.eta_s, r.n_stops_ahead, r.seats, r.crowding, r.is_last, r.vehicle) == (None, 3, None, 2, False, None)


def test_rail_feed(spark):
    rows = [
        {"subwayId": "1002", "barvlDt": "120", "recptnDt": "2024-01-01 08:59:20", "arvlCd": "99", "arvlMsg2": "[3]번째 전역 (강남)"},
        {"subwayId": "1002", "barvlDt": "20", "recptnDt": "2024-01-01 08:59:00", "arvlCd": "99"},
        {"subwayId": "1003", "barvlDt": "0", "recptnDt": "2024-01-01 08:59:59", "arvlCd": "1"},
        {"subwayId": "1004", "barvlDt": "0", "recptnDt": "2024-01-01 09:00:09", "arvlCd": "3"},
    ]
    now = F.lit(datetime(2024, 1, 1, 9)).cast("timestamp")
    got = feeds.rail_arrivals(bodies(spark, {"realtimeArrivalList": rows}), "k", now).collect()
    assert [(r.eta_s, r.age_s, r.n_stops_ahead) for r in got] == [(80, 40, 3), (None, 60, None), (0, 1, None), (None, 0, 1)]


def test_places(spark):
    docs = [{"place_name": " 역 ", "x": "127.1", "y": "37.1", "category_name": "부동산 > 산업단지", "address_name": "lot"}, {"place_name": "far", "x": "2", "y": "37"}, {"place_name": "", "x": "127", "y": "37"}]
    got = feeds.places(bodies(spark, {"documents": docs}), "k").collect()
    assert [(r.name, r.detail, r.address) for r in got] == [("역", "산업단지", "lot")]
    addresses = [{"road_address": None, "address": {"address_name": " "}}, {"road_address": {"address_name": "road"}, "address": {"address_name": "lot"}}]
    assert [r.address for r in feeds.reverse_address(bodies(spark, {"documents": addresses}, {}), "k").orderBy("k").collect()] == ["road", ""]
