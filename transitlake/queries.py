"""The registered queries outside the training-data operators, each with the SQL that gives the same rows.

The tables hold no transit data, so each operator works on a stated stand-in: keys give points, orders give journeys
and routes, events give departures and reports.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.functions import costs, geo, names, times
from transitlake.operators import fares, graphs, journeys, regions, registry, resolve, sequences, service, skyline, spatial
from transitlake.plans.storage import settled
from transitlake.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(key: Column) -> Column:
    return F.lit(126.5) + (key * 37 % 1000) / 1000


def lat(key: Column) -> Column:
    return F.lit(37.0) + (key * 91 % 1000) / 1000


def points(spark: SparkSession, sf_dir: str, name: str, key: str, a: str = "lon", b: str = "lat") -> DataFrame:
    return t(spark, sf_dir, name).select(key, lon(F.col(key)).alias(a), lat(F.col(key)).alias(b))


def _pt(k: str) -> tuple[str, str]:
    return f"(126.5::DOUBLE + ({k} * 37 % 1000) / 1000::DOUBLE)", f"(37.0::DOUBLE + ({k} * 91 % 1000) / 1000::DOUBLE)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))) END)"


_CX, _CY = _pt("c_custkey")
_SX, _SY = _pt("s_suppkey")
_CS = _hav(_CX, _CY, _SX, _SY)
#: Lines of an order, in a fixed order: the stops of a route.
_ROUTES = f"""
routes AS (
  SELECT l_orderkey AS route, l_suppkey AS stop, {_pt('l_suppkey')[0]} AS lon, {_pt('l_suppkey')[1]} AS lat,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice) - 1) AS pos
  FROM lineitem
)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    placed = sequences.positions(lines, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    return placed.select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("stop"), lon(F.col("l_suppkey")).alias("lon"), lat(F.col("l_suppkey")).alias("lat"), F.col("pos").cast("long").alias("pos"))


# --- joins in space ---------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, s_suppkey, round({_CS}, 3) AS dist_m FROM customer, supplier WHERE {_CS} <= 5000")
def grid_radius_join(spark, sf_dir):
    near = spatial.grid_join(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "lon2", "lat2"), 5_000)
    return near.select("c_custkey", "s_suppkey", F.round("dist_m", 3).alias("dist_m"))


@query(f"""
WITH p AS (SELECT c_custkey, s_suppkey, {_CS} AS d FROM customer, supplier WHERE {_CS} <= 10000),
r AS (SELECT *, CASE WHEN d <= 2000 THEN 0 ELSE 1 END AS ring FROM p),
f AS (SELECT *, min(ring) OVER (PARTITION BY c_custkey) AS fr FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rn FROM f WHERE ring = fr)
SELECT c_custkey, s_suppkey, ring, round(d, 3) AS dist_m, round(d * 1.39 / 0.83, 3) AS walk_s FROM n WHERE rn = 1""")
def nearest_with_expanding_radius(spark, sf_dir):
    best = spatial.nearest_within(points(spark, sf_dir, "customer", "c_custkey"), points(spark, sf_dir, "supplier", "s_suppkey", "lon2", "lat2"), [2_000, 10_000], "c_custkey", "s_suppkey")
    return best.select("c_custkey", "s_suppkey", "ring", F.round("dist_m", 3).alias("dist_m"), F.round(costs.walk_s(F.col("dist_m")), 3).alias("walk_s"))


_PA, _PB = _pt("a.p_partkey"), _pt("b.p_partkey")


@query(f"""SELECT a.p_partkey AS part_a, b.p_partkey AS part_b, round({_hav(*_PA, *_PB)}, 3) AS dist_m
FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey WHERE {_hav(*_PA, *_PB)} <= 6000""")
def same_key_twins(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    a = parts.select(F.col("p_partkey").alias("part_a"), "p_name", lon(F.col("p_partkey")).alias("lon"), lat(F.col("p_partkey")).alias("lat"))
    b = parts.select(F.col("p_partkey").alias("part_b"), "p_name", lon(F.col("p_partkey")).alias("lon2"), lat(F.col("p_partkey")).alias("lat2"))
    return spatial.grid_join(a, b, 6_000, on=["p_name"]).filter("part_a < part_b").select("part_a", "part_b", F.round("dist_m", 3).alias("dist_m"))


# Nations are squares, every third with a square hole; customers lie in them, on their sides, near them and far off.
_SQUARE = """
sq AS (SELECT n_nationkey AS k, n_name AS region, n_regionkey <> 0 AS in_scope, 126.5 + (n_nationkey % 5) * 0.1875 AS w, 37.0 + (n_nationkey // 5) * 0.1875 AS s FROM nation),
rings AS (SELECT region, w, s, w + 0.125 AS e, s + 0.125 AS n FROM sq UNION ALL SELECT region, w + 0.03125, s + 0.03125, w + 0.0625, s + 0.0625 FROM sq WHERE k % 3 = 0),
sides AS (SELECT region, w AS x0, w AS x1, s AS y0, n AS y1 FROM rings UNION ALL SELECT region, e, e, s, n FROM rings UNION ALL SELECT region, w, e, s, s FROM rings UNION ALL SELECT region, w, e, n, n FROM rings),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 51 = 0 THEN 190.0 ELSE 126.4375 + c_custkey * 37 % 1024 / 1024::DOUBLE + CASE WHEN c_custkey % 4 = 0 THEN 0.0003 ELSE 0 END END AS lon, 36.96875 + c_custkey * 91 % 1024 / 1024::DOUBLE AS lat FROM customer)"""
_BOX = max(regions.BOX_DEG, math.degrees(2000 / geo.EARTH_M) / math.cos(math.radians(39)))
_METRES = f"sqrt(pow(radians(greatest(greatest(x0, lon - {_BOX}), least(lon, least(x1, lon + {_BOX}))) - lon) * cos(radians(lat)) * {geo.EARTH_M}, 2) + pow(radians(greatest(greatest(y0, lat - {_BOX}), least(lat, least(y1, lat + {_BOX}))) - lat) * {geo.EARTH_M}, 2))"


@query(f"""WITH {_SQUARE},
ok AS (SELECT * FROM p WHERE lon BETWEEN 124 AND 132 AND lat BETWEEN 33 AND 39),
held AS (SELECT id, region FROM ok JOIN sides ON true GROUP BY id, region HAVING count(*) FILTER (WHERE x0 = x1 AND x0 > lon AND (y0 > lat) <> (y1 > lat)) % 2 = 1 OR count(*) FILTER (WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) > 0),
home AS (SELECT id, arg_min(region, (NOT in_scope, region)) AS region, bool_or(in_scope) AS in_scope, 'tie:' || string_agg(region, ',' ORDER BY NOT in_scope, region) AS tie, count(*) AS n FROM held JOIN sq USING (region) GROUP BY id),
away AS (SELECT id, region, min({_METRES}) AS m FROM ok JOIN sides ON x0 <= lon + {_BOX} AND x1 >= lon - {_BOX} AND y0 <= lat + {_BOX} AND y1 >= lat - {_BOX} WHERE id NOT IN (SELECT id FROM home) GROUP BY id, region),
near AS (SELECT id, region, in_scope, m FROM away JOIN sq USING (region) QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, NOT in_scope, region) = 1)
SELECT p.id AS point_id, CASE WHEN home.in_scope THEN home.region WHEN near.in_scope AND near.m <= 2000 THEN near.region END AS region,
  CASE WHEN home.in_scope THEN 'contain' WHEN near.in_scope AND near.m <= 2000 THEN 'snap' ELSE '' END AS method, CASE WHEN near.in_scope AND near.m <= 2000 THEN round(near.m, 1) END AS snap_dist_m,
  CASE WHEN ok.id IS NULL THEN 'invalid_coord' WHEN home.in_scope OR (near.in_scope AND near.m <= 2000) THEN '' ELSE 'outside_region' END AS drop_reason,
  CASE WHEN ok.id IS NULL THEN '' WHEN home.in_scope THEN CASE WHEN home.n > 1 THEN tie ELSE '' END WHEN home.id IS NOT NULL THEN 'contained:' || home.region WHEN near.id IS NULL THEN 'far' WHEN near.in_scope AND near.m <= 2000 THEN '' ELSE 'nearest:' || near.region || ' ' || round(near.m)::BIGINT || ' m' END AS detail
FROM p LEFT JOIN ok USING (id) LEFT JOIN home USING (id) LEFT JOIN near USING (id)""")
def region_assign(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    w, s = F.lit(126.5) + (k % 5) * 0.1875, F.lit(37.0) + F.floor(k / 5) * 0.1875
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    square = lambda a, b: F.array(corner(w + a, s + a), corner(w + b, s + a), corner(w + b, s + b), corner(w + a, s + b))
    rings = F.when(k % 3 == 0, F.array(square(0.0, 0.125), square(0.03125, 0.0625))).otherwise(F.array(square(0.0, 0.125)))
    places = t(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("in_scope"), rings.alias("rings"))
    x = F.when(c % 50 == 0, None).when(c % 51 == 0, 190.0).otherwise(F.lit(126.4375) + c * 37 % 1024 / 1024 + F.when(c % 4 == 0, 0.0003).otherwise(0.0))
    at = t(spark, sf_dir, "customer").select(c.alias("point_id"), x.alias("lon"), (F.lit(36.96875) + c * 91 % 1024 / 1024).alias("lat"))
    return regions.assign_regions(at, places)


@query(f"""
WITH r AS (SELECT n_nationkey AS rank, n_name AS region, n_regionkey <> 0 AS in_scope,
  126.5 + (n_nationkey % 5) * 0.18 AS w, 126.5 + (n_nationkey % 5) * 0.18 + 0.15 AS e, 37.0 + (n_nationkey // 5) * 0.18 AS s, 37.0 + (n_nationkey // 5) * 0.18 + 0.15 AS n FROM nation),
p AS (SELECT c_custkey AS point_id, {_CX} + 0.0003 AS lon, {_CY} + 0.0003 AS lat FROM customer),
h AS (SELECT p.point_id, r.* FROM p JOIN r ON lon >= w AND lon < e AND lat >= s AND lat < n)
SELECT p.point_id, h.region, CASE WHEN h.in_scope THEN 'contain' ELSE 'outside' END AS method FROM p JOIN h ON p.point_id = h.point_id""")
def region_contains(spark, sf_dir):
    k = F.col("n_nationkey")
    w, s = F.lit(126.5) + (k % 5) * 0.18, F.lit(37.0) + F.floor(k / 5) * 0.18
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(corner(w, s), corner(w + 0.15, s), corner(w + 0.15, s + 0.15), corner(w, s + 0.15))
    sides = regions.edges(t(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.array(ring).alias("rings")), ["region"])
    at = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (lon(F.col("c_custkey")) + 0.0003).alias("lon"), (lat(F.col("c_custkey")) + 0.0003).alias("lat"))
    scope = t(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.when(F.col("n_regionkey") != 0, "contain").otherwise("outside").alias("method"))
    return regions.containing(at, sides, "region").join(scope, "region").select("point_id", "region", "method")


# Parts are districts of 0.01 degrees square, those of one size a region: its boundary is what its districts don't share.
@query("""
WITH d AS (SELECT DISTINCT p_size AS region, p_partkey % 37 AS x, p_partkey % 41 AS y FROM part),
s AS (SELECT region, x AS ax, y AS ay, x + 1 AS bx, y AS "by" FROM d UNION ALL SELECT region, x, y + 1, x + 1, y + 1 FROM d UNION ALL SELECT region, x, y, x, y + 1 FROM d UNION ALL SELECT region, x + 1, y, x + 1, y + 1 FROM d)
SELECT region, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, "by"::DOUBLE AS "by" FROM s GROUP BY region, ax, ay, bx, "by" HAVING count(*) = 1""")
def dissolved_boundary(spark, sf_dir):
    k = F.col("p_partkey")
    corner = lambda x, y: F.struct((k % 37 + x).cast("double").alias("lon"), (k % 41 + y).cast("double").alias("lat"))
    districts = t(spark, sf_dir, "part").select(F.col("p_size").alias("region"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings")).distinct()
    return regions.dissolved(regions.edges(districts, ["region"]), ["region"])


@query(f"""
WITH p AS (SELECT c_custkey AS head_id, s_suppkey AS tail_id, {_CS} AS d, c_custkey % 600 AS at_s, s_suppkey % 900 AS rest_s FROM customer, supplier WHERE {_CS} <= 6000 AND {_CS} >= 150)
SELECT head_id, tail_id, round(at_s + 370 * pow(d / 1000, 0.7) + rest_s, 3) AS total_s FROM p WHERE at_s + 370 * pow(d / 1000, 0.7) + rest_s <= 1500""")
def head_tail_budget_join(spark, sf_dir):
    heads = points(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "head_id").withColumn("at_s", F.col("head_id") % 600)
    tails = points(spark, sf_dir, "supplier", "s_suppkey", "lon2", "lat2").withColumnRenamed("s_suppkey", "tail_id").withColumn("rest_s", F.col("tail_id") % 900)
    return spatial.budget_join(heads, tails, 6_000, 1_500, 150, costs.taxi_s(F.col("dist_m"), F.lit("normal"))).select("head_id", "tail_id", F.round("total_s", 3).alias("total_s"))


# --- registries -------------------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT a.p_partkey AS part_a, b.p_partkey AS part_b, {_hav(*_PA, *_PB)} AS d, replace(lower(a.p_name), ' ', '') AS ka, replace(lower(b.p_name), ' ', '') AS kb
  FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey),
m AS (SELECT part_a, part_b, CASE WHEN d <= 50 THEN 'merged_near' ELSE 'merged_far' END AS decision FROM p
  WHERE d <= 50 OR (d <= 300 AND (ka = kb OR (length(kb) >= 3 AND starts_with(ka, kb)) OR (length(ka) >= 3 AND starts_with(kb, ka)))))
SELECT * FROM m UNION ALL SELECT p_partkey, NULL, 'split' FROM part WHERE p_partkey NOT IN (SELECT part_a FROM m UNION ALL SELECT part_b FROM m)""")
def merge_decision(spark, sf_dir):
    k = F.col("p_partkey")
    parts = t(spark, sf_dir, "part").select("p_type", "p_brand", k.alias("id"), names.name_key(F.col("p_name")).alias("key"), lon(k).alias("lon"), lat(k).alias("lat"))
    return registry.merges(parts, ["p_type", "p_brand"]).withColumnsRenamed({"id_a": "part_a", "id_b": "part_b"})


@query("""
WITH m AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal)
SELECT c.c_custkey, m.s_suppkey FROM customer c LEFT JOIN m ON c.c_custkey = m.c_custkey AND m.rn = 1""")
def first_match_merge(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    candidates = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return registry.first_above(rows, candidates, "nation", "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders),
f AS (SELECT o_custkey, o_orderpriority AS v, min(rn) AS k FROM r GROUP BY 1, 2),
k AS (SELECT * FROM r WHERE rn = 1),
a AS (SELECT f.o_custkey, string_agg(f.v, '|' ORDER BY f.k) AS aliases FROM f JOIN k ON f.o_custkey = k.o_custkey WHERE f.v <> k.o_orderpriority GROUP BY 1)
SELECT k.o_custkey, k.o_orderkey, k.o_orderpriority, coalesce(a.aliases, '') AS aliases FROM k LEFT JOIN a ON k.o_custkey = a.o_custkey""")
def latest_row_dedupe(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return sequences.latest_rows(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], "o_orderpriority", "o_orderpriority").drop("o_orderdate")


@query("""
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' ELSE 'both' END AS status
FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k
WHERE b.k IS NOT NULL OR a.k % 2 = 0""")
def registry_refresh(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"))
    return registry.refreshed(old, new, "k", ["v"], F.col("k") % 2 == 0)


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW",
count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')) AS other FROM orders GROUP BY 1""")
def crosstab_pivot(spark, sf_dir):
    return registry.crosstab(t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "other")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return registry.duplicates(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def lost_keys(spark, sf_dir):
    waiting = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return registry.lost(t(spark, sf_dir, "customer"), waiting.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def code_table_lookup(spark, sf_dir):
    nations = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return registry.mapped(t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey")


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag AS v, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(v, '|' ORDER BY k, v) AS flags FROM f GROUP BY 1""")
def ordered_distinct_values(spark, sf_dir):
    return registry.ordered_values(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "flags")


@query("""
SELECT o.o_orderkey, coalesce(s.s_name, c.c_name) AS name FROM orders o
LEFT JOIN supplier s ON o.o_custkey = s.s_suppkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def fallback_cascade(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return registry.fallback_join(orders, "key", [(s, "id"), (c, "id")], "name").select("o_orderkey", "name")


# --- sequences --------------------------------------------------------------------------------------------------


@query(f"WITH {_ROUTES} SELECT route, stop, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS visits FROM routes GROUP BY 1, 2")
def route_sequence(spark, sf_dir):
    return sequences.occurrences(routes(spark, sf_dir), "route", "stop")


_GAP = _hav("plon", "plat", "lon", "lat")
_PREV = f"{_ROUTES}, g AS (SELECT *, lag(lon) OVER (PARTITION BY route ORDER BY pos) AS plon, lag(lat) OVER (PARTITION BY route ORDER BY pos) AS plat FROM routes)"


@query(f"WITH {_PREV} SELECT route, pos, round({_GAP}, 3) AS gap_m FROM g WHERE pos > 0")
def adjacent_gaps(spark, sf_dir):
    seq = sequences.with_previous(routes(spark, sf_dir), "route", ["lon", "lat"]).filter("pos > 0")
    return seq.select("route", "pos", F.round(geo.haversine_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat")), 3).alias("gap_m"))


@query(f"WITH {_PREV} SELECT route, pos, round(sum(coalesce({_GAP}, 0) / 6.0) OVER (PARTITION BY route ORDER BY pos), 3) AS cum_s FROM g")
def cumulative_ride(spark, sf_dir):
    return patterns(spark, sf_dir).select("route", "pos", F.round("cum_s", 3).alias("cum_s"))


def patterns(spark, sf_dir):
    seq = sequences.with_previous(routes(spark, sf_dir), "route", ["lon", "lat"])
    return sequences.running(seq, "route", geo.haversine_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat")) / 6.0, "cum_s")


@query(f"""
WITH {_PREV}, c AS (SELECT route, pos, sum(coalesce({_GAP}, 0) / 6.0) OVER (PARTITION BY route ORDER BY pos) AS cum_s FROM g)
SELECT a.route, a.pos, (a.pos - b.pos)::INTEGER AS ahead, round(a.cum_s - b.cum_s, 3) AS upstream_s FROM c a JOIN c b ON a.route = b.route AND b.pos < a.pos AND a.pos - b.pos <= 3""")
def upstream_time(spark, sf_dir):
    return sequences.upstream(patterns(spark, sf_dir), "route", "cum_s", 3).select("route", "pos", "ahead", F.round("upstream_s", 3).alias("upstream_s"))


@query(f"WITH {_ROUTES} SELECT a.route, a.stop AS board, b.stop AS alight, min(b.pos - a.pos) AS gap FROM routes a JOIN routes b ON a.route = b.route AND b.pos > a.pos GROUP BY 1, 2, 3")
def route_pair_gap(spark, sf_dir):
    return sequences.ordered_pairs(routes(spark, sf_dir), "route", "stop")


@query(f"""
WITH {_ROUTES}, p AS (SELECT a.route, a.stop AS board, b.stop AS alight, min(b.pos - a.pos) AS gap FROM routes a JOIN routes b ON a.route = b.route AND b.pos > a.pos GROUP BY 1, 2, 3),
e AS (SELECT *, abs(gap - 2) AS error FROM p)
SELECT route, board, alight, gap, error FROM (SELECT *, min(error) OVER (PARTITION BY board, alight) AS m FROM e) WHERE error = m""")
def route_best_gap(spark, sf_dir):
    return sequences.best_gap(sequences.ordered_pairs(routes(spark, sf_dir), "route", "stop"), 2)


@query(f"""
WITH {_ROUTES}, k AS (SELECT route, min(pos) AS lo, max(pos) AS hi FROM routes WHERE stop % 3 <> 0 GROUP BY 1)
SELECT r.route, r.pos, r.stop FROM routes r JOIN k ON r.route = k.route WHERE r.stop % 3 = 0 AND r.pos > lo AND r.pos < hi""")
def span_interior(spark, sf_dir):
    seq = routes(spark, sf_dir)
    return sequences.interior(seq.filter("stop % 3 <> 0"), seq.filter("stop % 3 = 0").select("route", "pos", "stop"), "route")


@query(f"""
WITH {_ROUTES}, k AS (SELECT route, pos, CASE WHEN stop % 3 <> 0 THEN lon END AS v FROM routes),
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY route ORDER BY pos) AS p0,
  min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY route ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM k)
SELECT w.route, w.pos, round(coalesce(w.v, a.v + (b.v - a.v) * ((w.pos - p0) / (p1 - p0)::DOUBLE)), 6) AS lon FROM w
LEFT JOIN k a ON a.route = w.route AND a.pos = p0 LEFT JOIN k b ON b.route = w.route AND b.pos = p1""")
def neighbour_interpolation(spark, sf_dir):
    seq = routes(spark, sf_dir).select("route", "pos", F.when(F.col("stop") % 3 != 0, F.col("lon")).alias("lon"))
    return sequences.interpolated(seq, "route", ["lon"]).select("route", "pos", F.round("lon", 6).alias("lon"))


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
w AS (SELECT user_id, pos, event_type AS a, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY pos) AS b, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY pos) AS c FROM s)
SELECT user_id, pos, 2 + CASE WHEN b = 'click' THEN 1 ELSE 0 END AS hits FROM w WHERE a = 'view' AND c = 'purchase'""")
def sequence_window_match(spark, sf_dir):
    seq = sequences.positions(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).withColumn("pos", F.col("pos").cast("long"))
    return sequences.window_matches(seq, "user_id", "event_type", ["view", "click", "purchase"])


# --- service ----------------------------------------------------------------------------------------------------


@query("""
WITH h AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n3 FROM h)
SELECT event_type, hour::INTEGER AS hour, n, n3::BIGINT AS n3, round(180.0 / n3, 1)::DOUBLE AS headway_m FROM w""")
def centred_window_headway(spark, sf_dir):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return service.centred_headway(service.departures_by_hour(t(spark, sf_dir, "events"), ["event_type"], minute, F.lit(False)), ["event_type"])


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_quantity::DOUBLE) AS h FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)
SELECT l_suppkey, round(1 / sum(1 / h), 6) AS headway, count(*) AS names FROM a GROUP BY 1""")
def frequency_sum_wait(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("double").alias("h"))
    return service.frequency_sum(lines, "l_suppkey", "l_returnflag", "h").withColumn("headway", F.round("headway", 6))


@query("""
SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 11 = 0 THEN true
 WHEN (o_custkey * 7 % 1440) <= (o_orderkey * 13 % 1440) THEN 480 BETWEEN (o_custkey * 7 % 1440) AND (o_orderkey * 13 % 1440)
 ELSE 480 >= (o_custkey * 7 % 1440) OR 480 <= (o_orderkey * 13 % 1440) END""")
def service_window_filter(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * 7 % 1440)
    return service.served(t(spark, sf_dir, "orders"), F.lit(480), first, F.col("o_orderkey") * 13 % 1440).select("o_orderkey")


@query("""
SELECT s_suppkey, d.day_type, CASE WHEN d.i = 0 THEN s_suppkey ELSE s_nationkey END::VARCHAR AS headway FROM supplier,
(VALUES ('평일', 0), ('토요일', 1)) AS d(day_type, i)""")
def unpivot_day_types(spark, sf_dir):
    wide = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("headway"), F.col("s_nationkey").alias("sat_headway"))
    return service.unpivot_days(wide, ["s_suppkey"], {times.WEEKDAY: "", times.SATURDAY: "sat_"}, ["headway"])


@query("""
WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS d, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT k, min(n) AS least, max(n) AS most, count(*) AS directions FROM c GROUP BY 1 HAVING min(n) * 2 < max(n)""")
def skewed_directions(spark, sf_dir):
    n = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("d")).count().withColumnRenamed("count", "n")
    return service.skewed_directions(n, "k", "d", "n")


@query()
def running_clock(spark, sf_dir):
    headways = F.create_map(*[x for line in range(4) for h in range(6, 30) for x in (F.lit(f"{line}:{h}"), F.lit(float(4 + (line * 5 + h) % 17)))])
    legs = routes(spark, sf_dir).select("route", "pos", (F.col("stop") % 23 + 3).cast("double").alias("ride_m"), (F.col("stop") % 5).cast("string").alias("line"))
    out = service.running_clock(legs.withColumn("headways", headways).withColumn("start", F.lit(400) + F.col("route") % 600), "route", F.col("start"), F.col("headways"))
    return out.select("route", F.round("arrive_m", 6).alias("arrive_m"), F.round("wait_m", 6).alias("wait_m"))


@query("""
SELECT l_suppkey, l_linestatus, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1, 2""")
def trips_by_direction(spark, sf_dir):
    return service.trips_by_direction(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_linestatus", "l_orderkey")


_DIRECTIONS = """WITH h AS (SELECT l_suppkey, l_linestatus AS direction, (l_orderkey % 24)::INTEGER AS hour, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, round(60.0::DOUBLE / n, 4) AS headway_m FROM h)"""


def direction_headways(spark, sf_dir):
    hours = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("direction"), (F.col("l_orderkey") % 24).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("headway_m", F.round(F.lit(60.0) / F.col("n"), 4))


@query(_DIRECTIONS + "SELECT l_suppkey, median(headway_m) AS peak_m FROM m WHERE hour = 8 GROUP BY 1")
def peak_headway_median(spark, sf_dir):
    return service.peak_median(direction_headways(spark, sf_dir), "l_suppkey", "headway_m")


@query(_DIRECTIONS + "SELECT l_suppkey, hour, round(avg(headway_m), 6) AS headway_m FROM m GROUP BY 1, 2")
def merged_direction_headway(spark, sf_dir):
    return service.merged_directions(direction_headways(spark, sf_dir), ["l_suppkey"], "headway_m").withColumn("headway_m", F.round("headway_m", 6))


@query("""
SELECT CASE WHEN l_partkey % 40 < 3 THEN 'too_close' WHEN l_partkey % 40 > 30 THEN 'too_far' WHEN l_quantity < 10 THEN 'no_saving' WHEN l_suppkey % 5 = 0 THEN 'off_band' END AS reason,
count(*) AS n FROM lineitem GROUP BY 1""")
def discard_reasons(spark, sf_dir):
    km = F.col("l_partkey") % 40
    reasons = {"too_close": km < 3, "too_far": km > 30, "no_saving": F.col("l_quantity") < 10, "off_band": F.col("l_suppkey") % 5 == 0}
    return service.reason_counts(t(spark, sf_dir, "lineitem"), reasons)


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 3 = 0 AS seoul, CASE WHEN o_orderkey % 25 < 24 THEN o_orderkey % 25 END AS hour, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 900 END AS eta FROM orders)
SELECT o_orderkey, CASE WHEN seoul AND (hour >= 22 OR hour < 4) THEN 1.2::DOUBLE WHEN NOT seoul AND (hour >= 23 OR hour < 4) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS night,
90 + coalesce(eta, 0) + CASE WHEN o_orderkey % 2 = 0 THEN 60 ELSE 0 END AS plan_s FROM o""")
def taxi_plan(spark, sf_dir):
    key = F.col("o_orderkey")
    night = costs.night_factor(F.col("o_custkey") % 3 == 0, F.when(key % 25 < 24, key % 25))
    return t(spark, sf_dir, "orders").select("o_orderkey", night.alias("night"), costs.taxi_plan_s(F.when(key % 7 > 0, key % 900), key % 2 == 0).alias("plan_s"))


_KINDS = ["마을", "순환", "지선", "일반", "간선", "심야", "광역", "직행", "시외", "공항", "관광"]


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 30000)::DOUBLE AS m, (l_suppkey % 11)::INTEGER AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, ([10, 10, 12, 13, 13, 15, 17, 17, 21, 21, 13])[i + 1]::DOUBLE AS kmh,
round(least(370 * pow(m / 1000, 0.7), m * 3.6 / 34 + 120), 4) AS rest_s FROM k""")
def ride_speeds(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("l_suppkey") % 11 + 1).cast("int"))
    rest = costs.rest_s((F.col("l_partkey") % 30000).cast("double"), F.lit("normal"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", costs.bus_kmh(kind).alias("kmh"), F.round(rest, 4).alias("rest_s"))


@query("""
WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || '행 - ' || n_name || '방면' WHEN 1 THEN s_name || '행 - ' || n_name ELSE replace(s_name, '#', '-') || '방면 ' END AS sign
FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN regexp_matches(sign, '-[^-]*방면\\s*$') THEN trim(regexp_extract(sign, '-([^-]*)방면\\s*$', 1)) END AS next_stop FROM s""")
def headsigns(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    to = F.concat("s_name", F.lit("행 - "), "n_name")
    sign = F.when(F.col("s_suppkey") % 3 == 0, F.concat(to, F.lit("방면"))).when(F.col("s_suppkey") % 3 == 1, to).otherwise(F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit("방면 ")))
    return rows.select("s_suppkey", names.headsign_next(sign).alias("next_stop"))


# --- aggregates and statistics ----------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS p50, quantile_cont(l_extendedprice::DOUBLE, 0.9) AS p90 FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT q.l_returnflag, round(p50, 4) AS p50, round(p90, 4) AS p90, round(r.v, 4) AS rank90 FROM q JOIN r ON q.l_returnflag = r.l_returnflag AND r.i = least(n - 1, floor(n * 0.9))""")
def quantiles_exact(spark, sf_dir):
    v = t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v")).filter("l_returnflag is not null")
    ranked = sequences.ranked(v.filter("v is not null"), ["v"], ["l_returnflag"], "m")
    # Null prices come last in the order of ranks and have no part in quantiles.
    flags = settled(v.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "flags")
    nearest = F.max(F.when(F.col("rank") - 1 == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9)), F.col("v")))
    wanted = [F.round(c, 4).alias(name) for name, c in (("p50", sequences.quantile("v", "rank", "m", 0.5)), ("p90", sequences.quantile("v", "rank", "m", 0.9)), ("rank90", nearest))]
    return flags.select("l_returnflag").join(ranked.join(F.broadcast(flags), "l_returnflag").groupBy("l_returnflag").agg(*wanted), "l_returnflag", "left")


@query("""
SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, count(*) FILTER (value > 50) AS matched, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def summary_by_kind(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("matched"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate")).select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", "matched", "rate")


@query("""
SELECT l_returnflag, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS slope, round(regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 2) AS intercept,
round(median(l_extendedprice::DOUBLE / l_quantity::DOUBLE), 4) AS multiplier FROM lineitem GROUP BY 1""")
def regression_fit(spark, sf_dir):
    v = t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x"))
    fit = v.groupBy("l_returnflag").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 2).alias("intercept"))
    ranked = sequences.ranked(v.select("l_returnflag", (F.col("y") / F.col("x")).alias("v")).filter("v is not null"), ["v"], ["l_returnflag"], "n")
    median = ranked.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.round(sequences.quantile("v", "rank", "n", 0.5), 4).alias("multiplier"))
    return fit.join(median, F.col("l_returnflag").eqNullSafe(F.col("_flag")), "left").drop("_flag")


@query("""
WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice, l_partkey) AS a,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_quantity, l_partkey) AS b FROM lineitem)
SELECT l_returnflag, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    tie = ["l_orderkey", "l_linenumber"]
    last = lambda *names: [F.asc_nulls_last(c) for c in names]
    v = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", *tie, "l_extendedprice", "l_partkey")
    a = sequences.ranked(v, last("l_quantity", *tie, "l_extendedprice", "l_partkey"), ["l_returnflag"]).withColumnRenamed("rank", "a")
    r = sequences.ranked(a, last("l_extendedprice", *tie, "l_quantity", "l_partkey"), ["l_returnflag"])
    return r.groupBy("l_returnflag").agg(F.round(F.corr(F.col("a").cast("double"), F.col("rank").cast("double")), 6).alias("rho"))


@query("""
WITH e AS (SELECT o_orderkey % 6 AS stage FROM orders)
SELECT s.i::INTEGER AS stage, count(*) FILTER (e.stage >= s.i) AS entered, count(*) FILTER (e.stage = s.i) AS removed FROM e, (VALUES (0), (1), (2), (3), (4), (5)) AS s(i) GROUP BY 1""")
def stage_funnel(spark, sf_dir):
    last = t(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 6).cast("int").alias("stage")).agg(F.count(F.lit(1)).alias("removed"))
    # Six rows are left, so one window over them all holds nothing of size.
    return last.select("stage", F.sum("removed").over(Window.partitionBy(F.lit(0)).orderBy(F.col("stage").desc())).alias("entered"), "removed")


# --- fronts and choices -----------------------------------------------------------------------------------------

_COSTS = "c AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS time_s, o_totalprice::DOUBLE AS fare FROM orders)"


def order_costs(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("time_s"), F.col("o_totalprice").cast("double").alias("fare"))


_NOT_DOMINATED = "NOT EXISTS (SELECT 1 FROM c d WHERE d.o_custkey = c.o_custkey AND d.time_s <= c.time_s AND d.fare <= c.fare AND (d.time_s < c.time_s OR d.fare < c.fare))"


@query(f"""WITH {_COSTS} SELECT o_custkey, time_s, fare, min(o_orderkey) AS o_orderkey FROM c WHERE {_NOT_DOMINATED} GROUP BY 1, 2, 3""")
def pareto_front(spark, sf_dir):
    return skyline.front(order_costs(spark, sf_dir), ["o_custkey"], "time_s", "fare", "o_orderkey")


@query(f"WITH {_COSTS} SELECT o_custkey, o_orderkey, time_s, fare FROM c WHERE {_NOT_DOMINATED}")
def pareto_keep_ties(spark, sf_dir):
    return skyline.front_with_ties(order_costs(spark, sf_dir), ["o_custkey"], "time_s", "fare", "o_orderkey").select("o_custkey", "o_orderkey", "time_s", "fare")


@query(f"""WITH {_COSTS} SELECT o_custkey, o_orderkey, CASE WHEN {_NOT_DOMINATED} THEN 0 ELSE 1 END AS tier FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.o_custkey = c.o_custkey AND c.time_s - d.time_s > 300 AND c.fare - d.fare >= 2000)""")
def pareto_band(spark, sf_dir):
    return skyline.banded(order_costs(spark, sf_dir), ["o_custkey"], "time_s", "fare", 300, 2000.0).select("o_custkey", "o_orderkey", "tier")


@query(f"""WITH {_COSTS}, r AS (SELECT *, time_s + fare / 300 * 60 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY time_s + fare / 300 * 60, o_orderkey) AS rn FROM c)
SELECT o_custkey, o_orderkey, round(g, 4) AS cost FROM r WHERE rn = 1""")
def argmin_generalised_cost(spark, sf_dir):
    best = skyline.least_by(order_costs(spark, sf_dir), ["o_custkey"], costs.generalised_s(F.col("time_s"), F.col("fare"), costs.VALUE_OF_TIME["balance"]), "o_orderkey")
    return best.select("o_custkey", "o_orderkey", F.round("cost", 4).alias("cost"))


@query(f"""WITH {_COSTS}, b AS (SELECT o_custkey, arg_min(time_s, (time_s, fare, o_orderkey)) AS bt, arg_min(fare, (time_s, fare, o_orderkey)) AS bf FROM c WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT c.o_custkey, c.o_orderkey, round(CASE WHEN bt - time_s > 0 THEN (fare - bf) / ((bt - time_s) / 60.0) END, 4)::DOUBLE AS won_per_minute, coalesce((fare - bf) / ((bt - time_s) / 60.0) <= 300 AND bt > time_s, false) AS recommended
FROM c JOIN b ON c.o_custkey = b.o_custkey WHERE c.o_orderkey % 2 = 1 AND bt <> time_s""")
def saving_per_minute(spark, sf_dir):
    c = order_costs(spark, sf_dir)
    base = skyline.least_by(c.filter("o_orderkey % 2 = 0"), ["o_custkey"], F.col("time_s"), "fare").select("o_custkey", F.col("time_s").alias("bt"), F.col("fare").alias("bf"))
    price = costs.saving_per_minute(F.col("bf"), F.col("fare"), F.col("bt"), F.col("time_s"))
    met = c.filter("o_orderkey % 2 = 1").join(base, "o_custkey").filter("bt <> time_s")
    return met.select("o_custkey", "o_orderkey", F.round(price, 4).alias("won_per_minute"), F.coalesce(price <= 300, F.lit(False)).alias("recommended"))


@query(f"""WITH {_COSTS}, e AS (SELECT o_custkey, time_s, fare, row_number() OVER (PARTITION BY o_custkey ORDER BY time_s, fare) AS rn FROM c WHERE o_orderkey % 2 = 0),
b AS (SELECT o_custkey, time_s AS bt, fare AS bf FROM e WHERE rn = 1),
k AS (SELECT c.*, bt, bf FROM c JOIN b ON c.o_custkey = b.o_custkey WHERE c.o_orderkey % 2 = 1 AND bt - c.time_s >= 300),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, time_s, fare ORDER BY o_orderkey) AS rn FROM k WHERE NOT EXISTS (SELECT 1 FROM k d WHERE d.o_custkey = k.o_custkey AND d.time_s <= k.time_s AND d.fare <= k.fare AND (d.time_s < k.time_s OR d.fare < k.fare)))
SELECT o_custkey, o_orderkey AS id, round((fare - bf) / ((bt - time_s) / 60.0), 4) AS won_per_minute, (fare - bf) / ((bt - time_s) / 60.0) <= 300 AS recommended FROM f WHERE rn = 1""")
def journey_plan(spark, sf_dir):
    c = order_costs(spark, sf_dir).withColumnRenamed("o_orderkey", "id")
    shown = skyline.plan(c.filter("id % 2 = 1"), c.filter("id % 2 = 0"), "o_custkey", costs.MIN_SAVING_S, costs.VALUE_OF_TIME["balance"])
    return shown.select("o_custkey", "id", F.round("won_per_minute", 4).alias("won_per_minute"), "recommended")


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o, l_returnflag) AS rn FROM c)
SELECT l_suppkey, l_returnflag FROM r WHERE rn = 1""")
def majority_value(spark, sf_dir):
    return skyline.majority(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_orderkey")


@query("""
WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS rn FROM events)
SELECT user_id, event_id, event_type FROM r WHERE rn = 1""")
def source_priority_pick(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return skyline.first_usable(e, ["user_id"], F.col("value") > 50, order, "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS eta, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 END AS ahead FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (eta IS NULL), eta, coalesce(ahead, 1000000), event_id) AS rank FROM e)
SELECT event_type, event_id, rank::INTEGER AS rank, true AS truncated FROM r WHERE rank <= 5""")
def arrival_order_topk(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("eta"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9).alias("ahead"))
    order = [F.col("eta").isNull(), F.col("eta"), F.coalesce("ahead", F.lit(1_000_000)), F.col("event_id")]
    return skyline.top_n(e, ["event_type"], order, 5).select("event_type", "event_id", "rank", "truncated")


# --- costs ------------------------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_minutes((o_orderkey * 17 % 1440)::BIGINT) AS tm, (o_custkey * 7 % 20000 + 300)::DOUBLE AS m, o_orderkey % 3 AS k FROM orders),
q AS (SELECT *, hour(tm) * 60 + minute(tm) AS mi, isodow(tm) AS dow FROM p),
b AS (SELECT *, CASE WHEN mi >= 1320 OR mi < 360 THEN 0.84 WHEN dow <= 5 AND ((mi >= 420 AND mi < 600) OR (mi >= 1020 AND mi < 1170)) THEN 1.2 ELSE 1.0 END AS f FROM q)
SELECT o_orderkey, round(370 * pow(m / 1000, 0.7) * f, 4)::DOUBLE AS taxi_s,
 (ceil(round((4800 + greatest(0, m * 1.42 / 1000 - CASE k WHEN 0 THEN 1.6 WHEN 1 THEN 1.8 ELSE 2.0 END) * CASE k WHEN 0 THEN 100 / 0.131 WHEN 1 THEN 100 / 0.104 ELSE 100 / 0.083 END) * 1.2 / 100, 6)) * 100)::BIGINT AS fare FROM b""")
def taxi_time_fare(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") * 17 % 1440).cast("int"))).alias("at"), (F.col("o_custkey") * 7 % 20000 + 300).cast("double").alias("m"), (F.col("o_orderkey") % 3).alias("k"))
    kind = F.when(F.col("k") == 0, "표준").when(F.col("k") == 1, "가").otherwise("나")
    return o.select("o_orderkey", F.round(costs.taxi_s(F.col("m"), costs.taxi_band(F.col("at"))), 4).alias("taxi_s"), costs.taxi_fare(F.col("m"), kind, F.lit(1.2)).cast("long").alias("fare"))


@query("""
SELECT o_orderkey, (1550 + 100 * (ceil(greatest(0, least(km, 50) - 10) / 5) + ceil(greatest(0, km - 50) / 8)))::BIGINT AS rail, (1500 + least(700, 100 * ceil(greatest(0, km - 10) / 5)))::BIGINT AS bus
FROM (SELECT o_orderkey, (o_orderkey * 7 % 9000) / 100.0::DOUBLE AS km FROM orders)""")
def distance_fare_steps(spark, sf_dir):
    km = (F.col("o_orderkey") * 7 % 9000) / 100.0
    return t(spark, sf_dir, "orders").select("o_orderkey", costs.rail_fare(F.lit(1550), km).cast("long").alias("rail"), costs.step_fare(F.lit(1500), F.lit(10.0), F.lit(5.0), km, F.lit(700)).cast("long").alias("bus"))


def _single_sql(m: str, base: str, free: str, mode: str) -> str:
    rail = f"100 * ceil(greatest(0.0, least({m}, 50000.0) - 10000.0) / 5000) + 100 * ceil(greatest(0.0, {m} - 50000.0) / 8000)"
    return f"({base} + CASE {mode} WHEN 'rail' THEN {rail} WHEN 'bus' THEN least(700.0, 100 * ceil(greatest(0.0, {m} - {free}) / 5000)) ELSE 0.0 END)"


_BOARD = "(route * 61 % 86400 + pos * (600 + stop * 31 % 2400))::DOUBLE"


def fold_sql(rides: str) -> str:
    """RECURSIVE CTEs: f has the state after each ride of rides(journey, pos, board, alight, m, mode, base, free, early, taxi, line); rows that share a position are choices."""
    return f"""{rides},
f AS (
  SELECT journey, pos, 0.0::DOUBLE AS closed, 1 AS groups, 1 AS n, base::DOUBLE AS base, free::DOUBLE AS free, m::DOUBLE AS m, 0.0::DOUBLE AS before, base::DOUBLE AS lbase, free::DOUBLE AS lfree, mode, m::DOUBLE AS lm, CASE WHEN board % 86400 < 23400 THEN early ELSE 0.0 END::DOUBLE AS off_,
    ({_single_sql('m', 'base', 'free', 'mode')} - CASE WHEN board % 86400 < 23400 THEN early ELSE 0.0 END)::DOUBLE AS paid, alight AS until_, line, NULL::BOOLEAN AS kept FROM rides WHERE pos = 0
  UNION ALL
  SELECT journey, pos, CASE WHEN joins THEN closed ELSE closed + paid END, groups + CASE WHEN joins THEN 0 ELSE 1 END, n2, base2, free2, m2, before2, lbase2, lfree2, mode2, lm2, off2,
    greatest(CASE WHEN joins THEN paid + greatest(0.0, base2 - base) ELSE 0.0 END, (CASE WHEN n2 = 1 THEN alone ELSE least(base2 + 100 * ceil(greatest(0.0, m2 - free2) / 5000), alone) END) - off2), until2, line2, CASE WHEN rtaxi THEN joins ELSE kept END
  FROM (SELECT *, before2 + {_single_sql('lm2', 'lbase2', 'lfree2', 'mode2')} AS alone FROM (
    SELECT r.journey, r.pos, joins, closed, groups, paid, base, alight AS until2, r.rline AS line2, kept, rtaxi,
      CASE WHEN inside THEN n WHEN joins THEN n + 1 ELSE 1 END AS n2,
      CASE WHEN inside THEN base WHEN joins THEN greatest(base, rbase) ELSE rbase END AS base2,
      CASE WHEN inside THEN free WHEN joins THEN greatest(free, rfree) ELSE rfree END AS free2,
      CASE WHEN joins THEN m + rm ELSE rm END AS m2,
      CASE WHEN inside THEN before WHEN joins THEN before + {_single_sql('lm', 'lbase', 'lfree', 'mode')} ELSE 0.0 END AS before2,
      CASE WHEN inside THEN lbase ELSE rbase END AS lbase2, CASE WHEN inside THEN lfree ELSE rfree END AS lfree2, CASE WHEN inside THEN mode ELSE rmode END AS mode2, CASE WHEN inside THEN lm + rm ELSE rm END AS lm2,
      CASE WHEN joins THEN off_ ELSE 0.0 END AS off2
    FROM (SELECT *, inside OR (n < 5 AND board - until_ <= CASE WHEN floor(board / 3600) % 24 >= 21 OR floor(board / 3600) % 24 < 7 THEN 3600 ELSE 1800 END AND NOT (mode = 'rail' AND rmode = 'rail') AND (line <> rline OR mode = 'rail' OR rmode = 'rail')) AS joins
      FROM (SELECT f.* EXCLUDE (journey, pos), r.journey, r.pos, r.board, r.alight, r.m::DOUBLE AS rm, r.base::DOUBLE AS rbase, r.free::DOUBLE AS rfree, r.mode AS rmode, r.line AS rline, r.taxi AS rtaxi, f.mode = 'rail' AND r.mode = 'rail' AND NOT r.taxi AS inside
        FROM f JOIN rides r ON r.journey = f.journey AND r.pos = f.pos + 1)) r))
)"""


_FOLD_RIDES = f"""{_ROUTES},
rides AS (SELECT route AS journey, pos, {_BOARD} AS board, {_BOARD} + 500 AS alight, (stop % 61 + 0.5) * 1000.0::DOUBLE AS m, CASE stop % 4 WHEN 0 THEN 'rail' WHEN 1 THEN 'flat' WHEN 2 THEN 'rail' ELSE 'bus' END AS mode,
  CASE stop % 4 WHEN 1 THEN 1500.0 WHEN 3 THEN 3200.0 ELSE 1550.0 END AS base, CASE stop % 4 WHEN 3 THEN 30000.0 ELSE 10000.0 END AS free, CASE stop % 4 WHEN 1 THEN 300.0 WHEN 3 THEN 400.0 ELSE 310.0 END AS early, stop % 5 = 0 AS taxi, (stop % 7)::VARCHAR AS line FROM routes)"""


@query(f"""WITH RECURSIVE {fold_sql(_FOLD_RIDES)}
SELECT journey, closed + paid AS fare, groups FROM f QUALIFY row_number() OVER (PARTITION BY journey ORDER BY pos DESC) = 1""")
def transfer_fare_fold(spark, sf_dir):
    r = routes(spark, sf_dir)
    kind = F.col("stop") % 4
    at = (F.col("route") * 61 % 86400 + F.col("pos") * (600 + F.col("stop") * 31 % 2400)).cast("double")
    by_kind = lambda flat, bus, rail: F.when(kind == 1, flat).when(kind == 3, bus).otherwise(rail)
    rides = r.select(
        F.col("route").alias("journey"), "pos", at.alias("board_s"), (at + 500).alias("alight_s"), (F.col("stop") % 61 + 0.5).cast("double").alias("km"), by_kind(1500.0, 3200.0, 1550.0).alias("base"), by_kind(10.0, 30.0, 10.0).alias("free_km"),
        by_kind("flat", "bus", "rail").alias("mode"), by_kind(300.0, 400.0, 310.0).alias("early"), (F.col("stop") % 5 == 0).alias("taxi"), (F.col("stop") % 7).cast("string").alias("route"),
    )
    return fares.transfer_fares(rides)


@query("""
WITH g AS (SELECT user_id, list_sort(list(event_id % 1800)) AS a FROM events GROUP BY 1),
c AS (SELECT user_id, a, (user_id * 37 % 2400)::BIGINT AS walk FROM g)
SELECT user_id, (coalesce(list_min(list_filter(a, lambda x: x >= walk)), list_max(a) + ceil((walk - list_max(a)) / 420.0) * 420) - walk)::DOUBLE AS wait_s FROM c""")
def first_catchable_arrival(spark, sf_dir):
    a = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 1800).alias("a")).withColumn("walk", (F.col("user_id") * 37 % 2400).cast("long"))
    return a.select("user_id", costs.first_wait_s(F.col("a"), F.col("walk"), F.lit(420)).cast("double").alias("wait_s"))


# --- matching ---------------------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT c_custkey, s_suppkey, lower(a.n_name) AS w, lower(b.n_name) AS k, {_CS} AS d FROM customer JOIN nation a ON c_nationkey = a.n_nationkey, supplier JOIN nation b ON s_nationkey = b.n_nationkey WHERE {_CS} <= 25000),
m AS (SELECT c_custkey, s_suppkey, d, CASE WHEN w = k THEN 0 WHEN least(length(w), length(k)) >= 4 AND (starts_with(k, w) OR starts_with(w, k)) THEN 3 END AS level FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY level, d, s_suppkey) AS rn, count(*) OVER (PARTITION BY c_custkey) AS n,
  lead(d) OVER (PARTITION BY c_custkey ORDER BY level, d, s_suppkey) AS nd, lead(level) OVER (PARTITION BY c_custkey ORDER BY level, d, s_suppkey) AS nl FROM m WHERE level IS NOT NULL)
SELECT c.c_custkey AS ask_id, r.s_suppkey AS stop_id, r.level::INTEGER AS level, round(r.d, 3) AS dist_m,
  CASE WHEN r.rn IS NULL THEN 'unmatched' WHEN (nl = level AND nd - d <= 500) OR (level > 1 AND n > 1) THEN 'ambiguous' ELSE 'matched' END AS status
FROM customer c LEFT JOIN r ON c.c_custkey = r.c_custkey AND r.rn = 1""")
def endpoint_resolution(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ask_id"), F.col("n_name").alias("name"), lon(F.col("c_custkey")).alias("lon"), lat(F.col("c_custkey")).alias("lat"))
    stops = t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("stop_id"), F.col("n_name").alias("stop_name"), F.array().cast("array<string>").alias("aliases"), lon(F.col("s_suppkey")).alias("lon2"), lat(F.col("s_suppkey")).alias("lat2"))
    return resolve.matched(asked, stops, 25_000, 500).withColumn("dist_m", F.round("dist_m", 3))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE rn = 1""")
def repeated_journeys(spark, sf_dir):
    j = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.array("o_orderstatus", "o_orderpriority").alias("rides"))
    return resolve.repeated_journeys(j, "o_custkey").select("o_custkey", F.col("pos").alias("o_orderkey"))


# --- graphs -----------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE p AS (SELECT s_suppkey AS id, {_SX} AS lon, {_SY} AS lat FROM supplier),
e AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE a.id <> b.id AND {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 12000),
w AS (SELECT id, id AS root FROM p UNION SELECT e.b AS id, w.root FROM w JOIN e ON w.id = e.a)
SELECT id, min(root) AS root FROM w GROUP BY 1""")
def components(spark, sf_dir):
    return graphs.near_components(points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "id"), 12_000)


def _ridden(spark, sf_dir):
    return patterns(spark, sf_dir).select(F.col("route").alias("pattern"), "pos", F.col("stop").alias("node"), "cum_s", (F.col("route") % 7 * 60).cast("double").alias("wait_s"))


def _starts(spark, sf_dir):
    """All suppliers, each at its own second of five hours: were it to rise with the id, the limit would leave out later ones."""
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 30 % 18000).cast("double").alias("at_s"))


@query(f"""
WITH {_PREV}, c AS (SELECT route AS pattern, stop AS node, pos, sum(coalesce({_GAP}, 0) / 6.0) OVER (PARTITION BY route ORDER BY pos) AS cum_s, (route % 7 * 60)::DOUBLE AS wait_s FROM g),
s AS (SELECT c.*, s_suppkey * 30 % 18000 + wait_s - cum_s AS start FROM c LEFT JOIN supplier ON node = s_suppkey),
a AS (SELECT node, pattern, min(start) OVER (PARTITION BY pattern ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + cum_s AS arrive FROM s)
SELECT node, round(min(arrive), 3)::DOUBLE AS at_s FROM a WHERE arrive <= 20000 GROUP BY 1""")
def reach_one_round(spark, sf_dir):
    return graphs.reach_round(_starts(spark, sf_dir), _ridden(spark, sf_dir), 20_000).select("node", F.round("at_s", 3).alias("at_s"))


@query()
def reach_two_rides(spark, sf_dir):
    spots = points(spark, sf_dir, "supplier", "s_suppkey")
    names = settled(spots.groupBy("lon", "lat").agg(F.min("s_suppkey").alias("a")), "places")
    near = spatial.grid_join(names, names.select(F.col("a").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), 5_000)
    walks = settled(near.select("a", "b", costs.walk_s(F.col("dist_m")).alias("walk_s")), "walks")
    places = settled(spots.join(names, ["lon", "lat"]).select(F.col("s_suppkey").alias("node"), F.col("a").alias("place")), "members")
    return graphs.reach(_starts(spark, sf_dir), _ridden(spark, sf_dir), walks, 2, 30_000, places).select("node", F.round("at_s", 3).alias("at_s"), "rides")


# Suppliers lie on thirty places in a row; rides of routes lead up to six places on, in whole minutes and fares; each tenth route is a taxi.
_PLACE = "stop % 30"
_EXACT_EDGES = f"""
n AS (SELECT {_PLACE} AS s, lead({_PLACE}) OVER (PARTITION BY route ORDER BY pos) AS t, CASE WHEN route % 10 = 0 THEN 'taxi' ELSE 'transit' END AS mode FROM routes),
e AS (SELECT DISTINCT s, t, mode, CASE mode WHEN 'taxi' THEN 2 ELSE (s * 7 + t * 5) % 9 + 4 END AS dt, CASE mode WHEN 'taxi' THEN (s + t) % 5 + 8 ELSE (s * 3 + t * 11) % 7 + 1 END AS df FROM n WHERE s < t AND t <= s + 6)"""


@query(f"""
WITH RECURSIVE {_ROUTES},{_EXACT_EDGES},
w AS (SELECT 0::BIGINT AS node, 0 AS taxis, 0::BIGINT AS time_s, 0::BIGINT AS fare UNION SELECT e.t, taxis + CASE WHEN mode = 'taxi' THEN 1 ELSE 0 END, time_s + dt, fare + df FROM w JOIN e ON node = s WHERE taxis + CASE WHEN mode = 'taxi' THEN 1 ELSE 0 END <= 1),
c AS (SELECT DISTINCT time_s, fare FROM w WHERE node = 29)
SELECT time_s::DOUBLE AS time_s, fare::DOUBLE AS fare FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.time_s <= c.time_s AND d.fare <= c.fare AND (d.time_s < c.time_s OR d.fare < c.fare))""")
def exact_pareto_journeys(spark, sf_dir):
    r = sequences.with_next(routes(spark, sf_dir).withColumn("place", F.col("stop") % 30), "route", ["place"])
    a, b, taxi = F.col("place"), F.col("next_place"), F.col("route") % 10 == 0
    time, fare = F.when(taxi, 2).otherwise((a * 7 + b * 5) % 9 + 4), F.when(taxi, (a + b) % 5 + 8).otherwise((a * 3 + b * 11) % 7 + 1)
    steps = r.filter("place < next_place and next_place <= place + 6").select(a.cast("string").alias("start"), b.cast("string").alias("end"), F.when(taxi, "taxi").otherwise("transit").alias("mode"), time.cast("double").alias("time_s"), fare.cast("double").alias("fare"))
    edges = steps.distinct()
    return graphs.exact_front(edges, "0", "29").select("time_s", "fare")


# --- names, numbers and nested values ---------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_NAMES = ["서울역(1호선)", "시청 역", "강남", "A·B[가]", "종로3가.탑골", "역", "가나역", "테스트(가(나))역"]


@query("""
SELECT p_partkey, name, regexp_replace(lower(replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(translate(name, '·ㆍ', '..'), '[]', '()'), ' ', ''), '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g'), '.', '')), '^(..+)역$', '\\1') AS key
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN mark || p_name ELSE p_name || mark END AS name FROM part JOIN (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + f""") AS m(i, mark) ON p_partkey % {len(_NAMES)} = i)""")
def name_key(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(mark, "p_name")).otherwise(F.concat("p_name", mark))
    return t(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("key", names.name_key(F.col("name"), station=True))


def _natural_names(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.concat((k * 7 % 50 + 1).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-"), (k % 12).cast("string"))).otherwise(""))
    return t(spark, sf_dir, "part").select("p_partkey", names.natural_key(n).alias("key"))


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(n, '^(\\d+)', 1)::BIGINT, coalesce(try_cast(regexp_extract(n, '-(\\d+)$', 1) AS BIGINT), -1), p_partkey) AS rank
FROM (SELECT p_partkey, (p_partkey * 7 % 50 + 1)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '-' || (p_partkey % 12)::VARCHAR ELSE '' END AS n FROM part)""")
def natural_sort(spark, sf_dir):
    return sequences.ranked(_natural_names(spark, sf_dir), ["key", "p_partkey"]).select("p_partkey", "rank")


@query("""
SELECT event_id, hour(ts) * 60 + minute(ts) AS minute, lpad(hour(ts)::VARCHAR, 2, '0') || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS hhmm,
 CASE isodow(ts) WHEN 6 THEN '토요일' WHEN 7 THEN '일요일' ELSE '평일' END AS day_type, (CASE WHEN hour(ts) < 2 THEN hour(ts) + 24 WHEN hour(ts) >= 5 THEN hour(ts) END)::INTEGER AS rail_hour,
 CASE WHEN hour(ts) >= 21 OR hour(ts) < 7 THEN 3600 ELSE 1800 END AS window_s FROM events""")
def service_clock(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("m", times.minutes_of(F.date_format("ts", "HH:mm:ss")))
    return e.select("event_id", F.col("m").cast("long").alias("minute"), times.hhmm(F.col("m")).alias("hhmm"), times.day_type(F.col("ts")).alias("day_type"), times.rail_hour(F.col("ts")).alias("rail_hour"), times.transfer_window_s(F.col("ts")).alias("window_s"))


# --- streams ----------------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return arrivals.as_stream(spark, f"{sf_dir}/events.parquet")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = arrivals.drained(arrivals.tumbling(_events(spark, sf_dir), "ts", ["event_type"], "1 hour", "2 hours", F.col("value")), "tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM o) x)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    out = arrivals.drained(arrivals.sessions(_events(spark, sf_dir), "ts", ["user_id"], "2 hours", None), "sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return arrivals.drained(arrivals.once_within(_events(spark, sf_dir), "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type"), "once")


@query("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS used, greatest(0, CASE event_type WHEN 'view' THEN 500 ELSE 60 END - count(*)) AS \"left\" FROM events GROUP BY 1, 2")
def daily_quota(spark, sf_dir):
    return arrivals.daily_quota(t(spark, sf_dir, "events"), "ts", "event_type", {"view": 500}, 60).withColumn("day", F.col("day").cast("string"))


from transitlake import journey_queries  # noqa: E402, F401  registers more of them
