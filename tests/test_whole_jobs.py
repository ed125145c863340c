"""Queries that must take all of their input, on small tables that a cut by id or file would show."""

import math
import os
import random

import duckdb
from pyspark.sql import functions as F

from transitlake import queries as core
from transitlake.operators import sequences

from test_queries import rows_of


def gives_its_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for x in tables:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{folder}/{x}.parquet{'/*.parquet' if (folder / f'{x}.parquet').is_dir() else ''}')")
    df = core.queries()[name](spark, str(folder))
    found = con.execute(core.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = df.collect()
    assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(columns, found.fetchall())
    return rows


def part_table(folder, where):
    duckdb.sql(f"COPY (SELECT i AS p_partkey, 'name ' || (i % 2) AS p_name, 'brand' AS p_brand, 'type ' || (i // 6000) AS p_type, (i % 50 + 1)::INTEGER AS p_size FROM range(1, 12000) r(i) WHERE {where}) TO '{folder}/part.parquet'")


def test_merges_reach_any_id(spark, tmp_path):
    part_table(tmp_path, "i % 1000 < 3 OR i % 400 = 7")
    rows = gives_its_sql(spark, tmp_path, "merge_decision", "part")
    got = {(r.part_a, r.part_b): r.decision for r in rows}
    assert got[1, 5001] == "merged_near"  # one place, ids far apart
    assert (1, 6001) not in got  # of another type
    parts = {x for (x,) in duckdb.sql(f"SELECT p_partkey FROM '{tmp_path}/part.parquet'").fetchall()}
    assert {x for pair in got for x in pair if x} == parts


def test_natural_ranks_take_all_parts(spark, tmp_path):
    part_table(tmp_path, "i < 3000")
    rows = gives_its_sql(spark, tmp_path, "natural_sort", "part")
    assert sorted(r["rank"] for r in rows) == list(range(1, 3000))


def test_ranks_go_on_from_range_to_range(spark):
    df = spark.range(500).selectExpr("id", "id * 7919 % 10 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        rows = sequences.ranked(df, ["v", "id"]).collect()
        assert df.repartitionByRange("v", "id").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.v, r.id))] == list(range(1, 501))
    assert sequences.ranked(df.filter("id < 0"), ["v", "id"]).count() == 0


def test_ranks_need_no_window_over_all_rows(spark):
    wide = sequences.ranked(spark.range(10), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in wide and "windowspecdefinition(id" not in wide


def route_tables(folder):
    ids = [1, 4, 30, 59, 85, 455, 510, 565, 601, 820, 1500, 1555]
    rng = random.Random(0)
    lines = [(o, i + 1, rng.choice(ids)) for o in range(1, 19) for i in range(rng.randrange(2, 5))] + [(90, 1, 2600), (90, 2, 2700)]
    duckdb.sql(f"COPY (SELECT unnest({[*ids, 2600, 2700]})::BIGINT AS s_suppkey) TO '{folder}/supplier.parquet'")
    duckdb.sql(f"COPY (SELECT o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, s::BIGINT AS l_suppkey, 1::BIGINT AS l_partkey, TIMESTAMP '2024-01-01' AS l_shipdate, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice FROM (VALUES {', '.join(map(str, lines))}) v(o, n, s)) TO '{folder}/lineitem.parquet'")
    return [*ids, 2600, 2700], lines


def test_one_round_starts_from_all(spark, tmp_path):
    route_tables(tmp_path)
    rows = gives_its_sql(spark, tmp_path, "reach_one_round", "supplier", "lineitem")
    assert 2700 in {r.node for r in rows}  # only one late id leads there


def test_two_rides_start_from_all(spark, tmp_path):
    ids, lines = route_tables(tmp_path)

    def metres(a, b):
        (x0, y0), (x1, y1) = [(math.radians(126.5 + k * 37 % 1000 / 1000), math.radians(37 + k * 91 % 1000 / 1000)) for k in (a, b)]
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1, math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2)))

    best = {i: (i * 30 % 18000, 0) for i in ids}
    for n in (1, 2):
        ridden = {}
        for o in {x[0] for x in lines}:
            stops = [x[2] for x in sorted(lines) if x[0] == o]
            for i, board in enumerate(stops):
                at = best[board][0] + o % 7 * 60
                for j in range(i + 1, len(stops)):
                    at += metres(stops[j - 1], stops[j]) / 6
                    if at <= 30_000:
                        ridden[stops[j]] = min(ridden.get(stops[j], at), at)
        walked = [(b, at + metres(a, b) * 1.39 / 0.83) for a, at in ridden.items() for b in ids if a != b and metres(a, b) <= 5000]
        for node, at in [*ridden.items(), *walked]:
            if at <= 30_000:
                best[node] = min(best[node], (at, n))
    got = {r.node: (r.at_s, r.rides) for r in core.queries()["reach_two_rides"](spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in best.items()}
    assert all(abs(got[k][0] - best[k][0]) < 0.01 for k in best)
    assert {r for _, r in got.values()} == {0, 1, 2}


def test_sessions_lose_no_late_file(spark, data, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(4):  # the newest rows come first
        part = folder / f"part-{i}.parquet"
        duckdb.sql(f"COPY (SELECT * EXCLUDE k FROM (SELECT *, ntile(4) OVER (ORDER BY ts DESC) - 1 AS k FROM '{data}/events.parquet') WHERE k = {i}) TO '{part}'")
        os.utime(part, (1_700_000_000 + 60 * i,) * 2)
    rows = gives_its_sql(spark, tmp_path, "stream_session", "events")
    assert sum(r.n for r in rows) == 1000
