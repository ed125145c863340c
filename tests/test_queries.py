"""Every registered query runs, and gives the rows of its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from transitlake import queries as core

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, (str, bytes, bool)):
        return v
    if isinstance(v, (decimal.Decimal, float, int)) or hasattr(v, "item"):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, data, oracle, name):
    df = core.queries()[name](spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = oracle.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
