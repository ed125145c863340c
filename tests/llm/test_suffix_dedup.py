import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from transitlake.llm import suffix_dedup


def brute(rows):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df, **more):
    return Counter(map(tuple, suffix_dedup.remove_repeats(df, **more).drop("kept").collect()))


@pytest.mark.parametrize("hot", [1, 3, 5_000])
def test_odd_texts(odd_docs, hot):
    # Rows of one id hold one text here, so their order doesn't show.
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: r[0])
    assert got(odd_docs, hot=hot) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [2, 5_000])
def test_passages_at_random(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    monkeypatch.setattr(suffix_dedup, "SORT_RUNS", 30)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 400))) for _ in range(8)]
    texts = ["".join(rng.choice(pool)[rng.randrange(20) : rng.randint(20, 400)] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 3000, "ab" * 900, "\x00" * 300]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert got(df, hot=hot) == brute(list(enumerate(texts)))


def test_kept_bytes_nulls_and_no_rows(spark, no_docs):
    rng = random.Random(1)
    p = "".join(rng.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([(2, "x" + p + "y"), (1, p), (None, p), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert rows == {None: p.encode(), 1: b"", 2: b"xy", 3: b""}
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (200, 5)).astype(np.uint64)
    order, group = suffix_dedup.multikey_order(words)
    rows = [tuple(words[i]) for i in order]
    assert rows == sorted(map(tuple, words))
    assert all((rows[i] == rows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, 200))
    assert all(order[i] > order[i - 1] for i in range(1, 200) if group[i] == group[i - 1])


def test_merged_spans():
    k, a, b = suffix_dedup.merged(np.array([2, 1, 1, 1, 2]), np.array([0, 5, 0, 20, 3]), np.array([4, 9, 5, 30, 9]))
    assert list(zip(k, a, b)) == [(1, 0, 9), (1, 20, 30), (2, 0, 9)]


def test_anchors_depend_on_content_only():
    rng = random.Random(3)
    p = bytes(rng.choice(b"abcd ") for _ in range(500))
    one, two = suffix_dedup.Runs([p]), suffix_dedup.Runs([b"z" * 37 + p, b"q"])
    inner = lambda r, at: {(a - at, lo - at, hi - at) for a, lo, hi in zip(r.anchor.tolist(), r.lo.tolist(), r.hi.tolist()) if 100 < lo - at and hi - at < 300}
    assert inner(one, 0) == inner(two, 37)
    assert sum((one.hi - one.lo + 1).tolist()) == 401
