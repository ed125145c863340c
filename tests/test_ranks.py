"""Ranks and quantiles of large groups: no task sorts a whole one."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from transitlake import queries as core
from transitlake.operators import graphs, sequences

from test_whole_jobs import gives_its_sql


def lines(folder, n, odd=True):
    rng = random.Random(n)
    rows = [(i // 3, i % 3, rng.choice("AAAANR"), float(rng.randrange(1, 9)), rng.randrange(100, 900) / 4, i % 50) for i in range(n)]
    if odd:
        rows += [(n, i, "Z", 2.0, None, i) for i in range(3)] + [(n, 9, "N", 3.0, None, i) for i in range(2)] + [(n + 1, 0, "one", 4.0, 5.25, 1)]
    value = lambda x: "NULL" if x is None else repr(x)
    duckdb.execute(f"COPY (SELECT o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, f AS l_returnflag, q::DOUBLE AS l_quantity, e::DOUBLE AS l_extendedprice, p::BIGINT AS l_partkey FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v(o, n, f, q, e, p)) TO '{folder}/lineitem.parquet'")


@pytest.mark.parametrize("name", ["quantiles_exact", "regression_fit"])
@pytest.mark.parametrize("n", [0, 1, 2, 11, 400])
def test_quantiles_with_nulls(spark, tmp_path, name, n):
    lines(tmp_path, n)
    gives_its_sql(spark, tmp_path, name, "lineitem")


def test_rank_correlation_in_order_of_its_sql(spark, tmp_path):
    lines(tmp_path, 300)
    gives_its_sql(spark, tmp_path, "rank_correlation", "lineitem")


@pytest.mark.parametrize("name", ["rank_correlation", "quantiles_exact", "regression_fit"])
def test_no_group_is_sorted_or_held_whole(spark, tmp_path, name, monkeypatch):
    lines(tmp_path, 200, False)
    sizes, ranked = [], sequences.ranked

    def seen(*args, **named):
        out = ranked(*args, **named)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(l_returnflag" in plan and "l_extendedprice#" not in "".join(x for x in plan.split("\n") if "windowspec" in x)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(sequences, "ranked", seen)
    plan = core.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sizes and set(sizes) == {200}
    assert "percentile" not in plan and "median" not in plan and "row_number" not in plan


def test_ranks_by_key_over_ranges(spark):
    df = spark.range(600).selectExpr("id", "CASE WHEN id % 5 < 3 THEN 'a' WHEN id % 5 = 3 THEN 'b' END AS k", "id * 7919 % 10 AS v")
    rows = sequences.ranked(df, ["v", F.desc("id")], ["k"], "n").collect()
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: (r.v, -r.id))
        assert [(r["rank"], r.n) for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))] and mine


def test_walks_are_found_once_a_place(spark, data, monkeypatch):
    met, reach = [], graphs.reach
    monkeypatch.setattr(graphs, "reach", lambda start, patterns, walks, *rest: met.append((walks.count(), rest[2].count())) or reach(start, patterns, walks, *rest))
    twice = lambda s, d, name: once(s, d, name).unionByName(once(s, d, name).withColumn("s_suppkey", F.col("s_suppkey") + 1_000)) if name == "supplier" else once(s, d, name)
    once = core.t
    core.queries()["reach_two_rides"](spark, data)
    monkeypatch.setattr(core, "t", twice)
    core.queries()["reach_two_rides"](spark, data)
    (walks, members), (walks2, members2) = met
    assert walks2 == walks and members2 == 2 * members > 0


@pytest.mark.parametrize("limit", [600.0, 1_500.0])
def test_reach_by_places_as_by_nodes(spark, limit):
    place = {n: n % 4 for n in range(12)}
    apart = {(a, b): abs(a - b) * 50.0 for a in range(4) for b in range(4) if abs(a - b) <= 2}
    stops = spark.createDataFrame([(p, i, (p * 5 + i * (p % 3 + 1) * 2) % 12, float(i * (90 + p * 7 % 40)), float(p % 3 * 60)) for p in range(9) for i in range(5)], "pattern long, pos long, node long, cum_s double, wait_s double")
    start = spark.createDataFrame([(0, 10.0), (5, 700.0)], "node long, at_s double")
    by_place = spark.createDataFrame([(a, b, w) for (a, b), w in apart.items()], "a long, b long, walk_s double")
    by_node = spark.createDataFrame([(m, n, apart[place[m], place[n]]) for m in place for n in place if m != n and (place[m], place[n]) in apart], "a long, b long, walk_s double")
    got = graphs.reach(start, stops, by_place, 2, limit, spark.createDataFrame(list(place.items()), "node long, place long")).collect()
    assert sorted(got) == sorted(graphs.reach(start, stops, by_node, 2, limit).collect()) and {r.rides for r in got} >= {0, 1}
