import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from transitlake.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, f int, phrase string, bucket string, blob string"


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)) if (w := re.findall(r"[^ \t]+", p))]


def brute(rows, longest, least, share, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for w in pieces(text):
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und"][tuple(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        total = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                score, cut = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), a, counts[p[:cut]], counts[p[cut:]], total, score, cut))
        for rank, (_, _, phrase, a, left, right, n, score, cut) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, score, cut))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefg", "É", "é", "the", "THE", "漢字", "x-1", "\xa0nb", "a\x00b", "\x1cq"]
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", *map(str, range(40))]) for _ in range(70))
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((text + rng.choice(["", "", f". {passage}. ", f" {passage} "]), rng.choice(["en", "de", None, "und", "e n\n"])))
    return rows + [(None, "en"), ("", "de"), (None, None), ("one", "fr"), ("one two", "fr"), (" \t\n", "fr"), *[("lone pair", "it")] * 12, *[(passage, "it")] * 11]


def as_docs(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "p", "b", "x") for t, lang in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("longest, least, share, top", [(3, 10, 50, 2000), (3, 2, 50, 7), (2, 3, 100, 50), (4, 3, 60, 400), (3, 1, 0, 10**6)])
def test_brute_force(spark, longest, least, share, top):
    rows = made(longest * 10 + least, 120)
    got = collocations.collocations(as_docs(spark, rows), longest, least, share, top)
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, share, top)


def test_small_parts(spark, monkeypatch):
    """Texts cut into slices, edges sent in many parts, many buckets, paths in sections."""
    for name, value in (("SLICE_BYTES", 40), ("SEND_WORDS", 90), ("BUCKET_BYTES", 3_000), ("HELD_EDGES", 50), ("SECTION", 3)):
        monkeypatch.setattr(collocations, name, value)
    rows = made(5, 60) + [("hot pair " * 3_000, "en"), (" ".join(f"hot pair {i}" for i in range(800)), "en")]
    got = collocations.collocations(as_docs(spark, rows), 3, 4, 50, 500)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 4, 50, 500)


def test_paths(spark):
    rows = [("a b c d e f g h", "en")] * 5 + [("x c d e y", "en")] * 4
    found, total = collocations.counted(as_docs(spark, rows), 3, 1)
    assert total.collect()[0].n == 60
    assert {(r.phrase, r.f) for r in found[1].collect()} == {("a", 5), ("b", 5), ("c", 9), ("d", 9), ("e", 9), ("f", 5), ("g", 5), ("h", 5), ("x", 4), ("y", 4)}
    paths = {(" ".join(r.words), r.weight, r.in_flow, r.out_flow) for r in collocations.compacted(found, 3).collect()}
    assert paths == {("a b c d", 5, 5, 9), ("x c d", 4, 4, 9), ("c d e", 9, 9, 9), ("d e f g h", 5, 9, 5), ("d e y", 4, 9, 4)}


def test_large_counts_are_exact(spark):
    """Products over 64 bits."""
    big = 3_000_000_019
    phrases = spark.createDataFrame([("en", "x y", big)], "lang string, phrase string, a long")
    counts = spark.createDataFrame([("en", "x", big + 7), ("en", "y", big + 11)], "lang string, phrase string, f long")
    row = collocations._scored(phrases, 2, {1: counts}).first()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_rows_too_wide_to_pack():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 3, 500, dtype=np.int64), *[rng.choice(np.array([0, 1, 2**31 - 1, 2**30]), 500) for _ in range(3)]]
    got, n = collocations.combined(cols, np.ones(500, dtype=np.int64))
    want = Counter(zip(*[c.tolist() for c in cols]))
    assert dict(zip(zip(*[c.tolist() for c in got]), n.tolist())) == want
    assert list(zip(*[c.tolist() for c in got])) == sorted(want)


def test_no_documents(spark):
    assert collocations.collocations(as_docs(spark, []).limit(0)).count() == 0


def test_sql(spark, tmp_path):
    import duckdb

    rows = made(77, 400)
    as_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = collocations.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(con.sql(collocations.SQL).fetchall())
