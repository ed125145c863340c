import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from transitlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code string, error int"


def brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], label) for i, v, label in kept]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows_of(kept, k)))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda e: (d2(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p]), []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], {}
    for (i, _, label), c in zip(kept, cut):
        code = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d2(c[p], books[p][code[p]]) for p in range(parts))
        totals[label] = totals.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for e in code), error))
    top = (1 << 63) - 1
    return sorted(((i, label, code, min(e, top), min(totals[label], top), sha) for i, label, code, e in out), key=str)


def rows_of(kept, k):
    return kept[k][1]


def table(spark, rows, n=3):
    return spark.createDataFrame([(i, v, label, "v", "c", 1) for i, v, label in rows], SCHEMA).repartition(n)


def made(seed, n, width, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, spread / 5) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in rng.sample(range(10 * n), n)]
    return rows + [(10**6 + i, rows[i][1], 3) for i in range(5)] + [(10**7, [0.0] * width, 4)] * 3


ODD = [(5, None, 1), (6, [None] * 8, 1), (7, [float("nan")] * 8, 1), (8, [float("inf"), *[0.0] * 7], 1), (9, [], 1), (10, [1.0] * 16, 1), (11, [1.0] * 7, 1)]


@pytest.mark.parametrize("block, leaf", [(8192, 48), (50, 4), (400, 1)])
def test_brute_force(spark, block, leaf):
    rows = made(block, 600, 8)
    got = vector_codes.vector_codes(table(spark, rows + ODD), parts=4, entries=16, block=block, leaf=leaf)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 16, 2)


def test_grids_full_of_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(8)], i % 3) for i in range(900)]
    got = vector_codes.vector_codes(table(spark, rows), parts=4, entries=64, block=300, leaf=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 64, 2)


def test_large_components_are_exact(spark):
    rows = made(9, 80, 8) + [(-1, [1e300, -1e300, 1.5, 2.0**60, 0.0, 0.0, 3e9, -3e9], 1), (-2, [1e300, -1e299, 1.5, 2.0**61, 0.0, 0.25, 3e9, 3e9], 2), (2**53 + 1, [0.001] * 8, None)]
    got = vector_codes.vector_codes(table(spark, rows), parts=4, entries=8, block=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 8, 2)


def test_few_rows_null_ids_and_no_rows(spark):
    rows = [(None, [1.0] * 8, None), (3, [2.0] * 8, None), (None, [-1.0] * 8, 1)]
    got = vector_codes.vector_codes(table(spark, rows), parts=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 64, 2)
    assert vector_codes.vector_codes(table(spark, ODD[:5]), parts=4).count() == 0
    assert vector_codes.vector_codes(table(spark, []), parts=4).count() == 0


def test_labels_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    rows = made(4, 200, 8)
    got = vector_codes.vector_codes(table(spark, rows), parts=2, entries=20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2, 20, 2)


@pytest.mark.parametrize("n, spread", [(1, 1), (47, 1), (49, 1), (3000, 1), (3000, 10_000)])
def test_balls(n, spread):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(0, 60, (n, 4)) * spread / 2 ** rng.integers(0, 8, (n, 1))).astype(np.int64)
    tree = vector_codes.Tree.build(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    for i in range(len(tree.lo)):
        own = points[tree.order[tree.lo[i] : tree.hi[i]]]
        assert (tree.sums[i] == own.sum(axis=0)).all()
        assert np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= tree.radius[i] * (1 + 1e-9) + 1e-9
        if tree.left[i] >= 0:
            assert tree.lo[tree.left[i]] == tree.lo[i] and tree.hi[tree.left[i]] == tree.lo[tree.right[i]] and tree.hi[tree.right[i]] == tree.hi[i]
        else:
            assert len(own) <= vector_codes.LEAF or len(np.unique(own, axis=0)) == 1
    book = points[rng.integers(0, n, 64)]
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    entry, error = vector_codes.nearest(tree, book)
    assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    sums, counts = tree.totals(book)
    assert (counts == np.bincount(entry, minlength=64)).all() and all((sums[e] == points[entry == e].sum(axis=0)).all() for e in range(64))


def test_lists_shrink():
    """Far groups: whole balls are owned, and far fewer distances are taken than points times entries."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-50_000, 50_000, (64, 4))
    points = centres[rng.integers(0, 64, 8_000)] + rng.integers(-50, 50, (8_000, 4))
    tree = vector_codes.Tree.build(points)
    (balls, _), places, _, measured = tree.walk(centres)
    assert (tree.hi[balls] - tree.lo[balls]).sum() + len(places) == 8_000
    assert len(places) < 800 and measured < 8_000 * 64 / 20


def test_sql(spark, tmp_path):
    import duckdb

    rows = made(77, 300, 32)
    seen = {i: (i, v, label) for i, v, label in rows}
    table(spark, list(seen.values()) + [(-5, None, 1), (-6, [float("nan")] * 32, 1), (-7, [None] * 32, 1)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(vector_codes.SQL).fetchall())
