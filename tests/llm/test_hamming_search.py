import random

import pytest
from pyspark.sql import functions as F

from transitlake.llm import hamming_search


def brute(rows, queries, k):
    rows = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    out = set()
    for q, qc in {(i, c) for i, c in queries if i is not None and c is not None}:
        ranked = sorted((bin((c ^ qc) & (2**64 - 1)).count("1"), i) for i, c in rows)[:k]
        out |= {(q, r, i, d) for r, (d, i) in enumerate(ranked, 1)}
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "few"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(8)
    if kind == "random":
        codes = [rng.getrandbits(64) for _ in range(400)]
    elif kind == "clusters":
        heads = [rng.getrandbits(64) for _ in range(8)]
        codes = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for h in heads for _ in range(50)]
    elif kind == "copies":
        codes = [5] * 150 + [rng.getrandbits(64) for _ in range(100)]
    else:
        codes = [0, 2**64 - 1, 2**63]
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(0, signed(codes[0])), (None, 3), (10_000, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = hamming_search.top_k(df, df.filter("id % 50 = 0 or id is null"), 10).collect()
    assert {tuple(r) for r in got} == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 10)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, code long")
    one = spark.createDataFrame([(1, 2)], "id long, code long")
    assert hamming_search.top_k(none, one).count() == 0
    assert hamming_search.top_k(one, none).count() == 0
    assert [tuple(r) for r in hamming_search.top_k(one, one).collect()] == [(1, 1, 1, 0)]


def test_sign_code(spark):
    v = [(-1.0) ** i for i in range(64)]
    df = spark.createDataFrame([(1, v), (2, [1.0] * 64), (3, [0.0] * 64), (4, None), (5, [None, 2.0])], "id long, v array<double>")
    got = {r.id: r.code for r in df.select("id", hamming_search.sign_code(F.col("v")).alias("code")).collect()}
    assert got == {1: 0x5555555555555555, 2: -1, 3: 0, 4: None, 5: 2}


def test_segments():
    assert hamming_search.segments(64, 5) == [(0, 12), (12, 13), (25, 13), (38, 13), (51, 13)]
