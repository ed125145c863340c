import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transitlake.llm import mixing, token_ids

LEVELS = lambda: {"domain": F.substring("source", 1, 1), "lang": F.col("lang"), "source": F.col("source")}


@pytest.fixture(scope="module")
def count():
    library = Tokenizer.from_file(token_ids.default_tokenizer())
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        source = "a1" if i % 3 == 0 else rng.choice(["a1", "a2", "b1", "b2", "b3", "c1"])
        rows.append((i, " ".join(rng.choice(["w", "word", "2024", "onanatin,"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", "fr"]) if source != "c1" else "xx", source, "clash", 7))
    rows += rows[10:14]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, leaf string, bucket int")


# A lambda travels to workers whole; they can't import this module.
weight = lambda path: {"a": 3.0, "b": 1.0, "c": 5.0}.get(path[0], 1.0) if len(path) == 1 else {"en": 2.0}.get(path[1], 1.0) if len(path) == 2 else 1.0


def totals(rows, count):
    out = defaultdict(int)
    for r in rows:
        out[(r.source[0], r.lang, r.source)] += count(r.text)
    return {k: v for k, v in out.items() if v}


def brute(leaves, budget, weight, epochs):
    """Each node's budget by bisection for the rate at which min(capacity, rate * weight) of its children adds up to it."""
    out = {}

    def down(path, amount):
        below = sorted({k[: len(path) + 1] for k in leaves if k[: len(path)] == path and len(k) > len(path)})
        if not below:
            out[path] = math.floor(amount + 1e-6)
            return
        cap = {c: epochs * sum(v for k, v in leaves.items() if k[: len(c)] == c) for c in below}
        low, high = 0.0, 1e12
        for _ in range(300):
            rate = (low + high) / 2
            low, high = (rate, high) if sum(min(cap[c], rate * weight(c)) for c in below) < amount else (low, rate)
        for c in below:
            down(c, min(cap[c], high * weight(c)))

    down((), min(budget, epochs * sum(leaves.values())))
    return out


def given(spark, leaves, budget, weight, epochs):
    depth = len(next(iter(leaves)))
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()], ", ".join(f"level{i} string" for i in range(depth)) + ", tokens long")
    import json

    return {tuple(json.loads(r.leaf)): r.quota for r in mixing.budgets(table, depth, weight, budget, epochs).collect()}


@pytest.mark.parametrize("share", [0.05, 1.0, 3.0, 9.0])
def test_budgets(spark, docs, count, share):
    leaves = totals(docs.collect(), count)
    got, want = given(spark, leaves, share * sum(leaves.values()), weight, 4), brute(leaves, share * sum(leaves.values()), weight, 4)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_budgets_of_random_trees(spark):
    rng = random.Random(4)
    leaves = {(rng.choice("ab"), rng.choice("cde"), f"s{i}"): rng.choice([1, 10, rng.randint(1, 10**6)]) for i in range(120)}
    w = lambda path: {"a": 0.3, "c": 7.0, "s3": 0.0}.get(path[-1], 1.0)
    for share in (0.01, 0.5, 1.9):
        got, want = given(spark, leaves, share * sum(leaves.values()), w, 2), brute(leaves, share * sum(leaves.values()), w, 2)
        assert all(abs(got[k] - want[k]) <= 1 for k in want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("d", "en", "s1"): 10, ("d", "en", "s2"): 1000, ("d", "de", "s3"): 1000, ("e", "en", "s4"): 1000}
    assert given(spark, leaves, 400, lambda p: 1.0, 1) == {("d", "en", "s1"): 10, ("d", "en", "s2"): 90, ("d", "de", "s3"): 100, ("e", "en", "s4"): 200}
    assert given(spark, {**leaves, ("d", "en", "s2"): 20}, 400, lambda p: 1.0, 1) == {("d", "en", "s1"): 10, ("d", "en", "s2"): 20, ("d", "de", "s3"): 170, ("e", "en", "s4"): 200}


@pytest.mark.parametrize("share", [0.3, 2.5])
@pytest.mark.parametrize("bucket_docs", [8, 4096])
def test_each_leaf_gives_the_prefix_of_its_order(spark, docs, count, share, bucket_docs):
    rows = docs.collect()
    leaves = totals(rows, count)
    quotas = given(spark, leaves, share * sum(leaves.values()), weight, 4)
    want = Counter()
    for leaf, quota in quotas.items():
        mine = [r for r in rows if (r.source[0], r.lang, r.source) == leaf and count(r.text)]
        full, rest = divmod(quota, leaves[leaf])
        want.update((r.doc_id, e, count(r.text)) for r in mine for e in range(full))
        ids = spark.createDataFrame([(r.doc_id, count(r.text)) for r in mine], "doc_id long, n int").withColumn("h", mixing._order(F.lit(full).cast("long")))
        # Unsigned order of the bits that buckets are cut by, then of the rest.
        for r in sorted(ids.collect(), key=lambda r: ((r.h % 2**64) >> 1 >> (63 - bits_of(len(mine), bucket_docs)), r.h, r.doc_id, r.n)):
            if rest <= 0:
                break
            want[(r.doc_id, full, min(r.n, rest))] += 1
            rest -= r.n
    got = mixing.mix(docs, LEVELS(), weight, share, 4, bucket_docs=bucket_docs).collect()
    assert Counter((r.doc_id, r.epoch, r.taken) for r in got) == want
    spent = Counter()
    for r in got:
        spent[(r.domain, r.lang, r.source)] += r.taken
    assert spent == Counter({k: v for k, v in quotas.items() if v})  # to the token
    whole = mixing.mixed_documents(docs, LEVELS(), weight, budget_share=share, bucket_docs=bucket_docs)
    assert whole.columns == docs.columns
    found = whole.collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in got)
    text = {r.doc_id: r.text for r in rows}
    assert all(text[r.doc_id].startswith(r.text) and r.text for r in found)
    assert sum(r.text != text[r.doc_id] for r in found) == sum(r.taken < r.n_tokens for r in got)


def bits_of(n, bucket_docs):
    return max(0, math.ceil(math.log2(max(1, n / bucket_docs))))


def test_a_document_longer_than_its_budget_is_cut(spark, count):
    rows = [(1, "w " * 1000, "en"), (2, "w " * 1000, "de"), (3, "w " * 10, "fr"), (4, "漢字" * 400, "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    levels = {"lang": F.col("lang")}
    got = {r.doc_id: r for r in mixing.mix(docs, levels, lambda p: 1.0, 0.2, 1).collect()}
    total = sum(count(r[1]) for r in rows)
    assert sum(r.taken for r in got.values()) in range(math.floor(0.2 * total) - 3, math.floor(0.2 * total) + 1)
    assert got[3].taken == 10 and got[1].taken == got[2].taken == got[4].taken
    found = {r.doc_id: r.text for r in mixing.mixed_documents(docs, levels, lambda p: 1.0, budget_share=0.2, max_epochs=1).collect()}
    assert count(found[1]) == got[1].taken and abs(count(found[4]) - got[4].taken) <= 1


def test_many_leaves_are_joined_by_shuffle(spark, docs, monkeypatch):
    want = Counter(map(tuple, mixing.mix(docs, LEVELS(), weight, 0.6).collect()))
    monkeypatch.setattr(mixing.shared, "few", lambda df, rows=0: df)
    assert Counter(map(tuple, mixing.mix(docs, LEVELS(), weight, 0.6).collect())) == want


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, mixing.production_levels(), mixing.production_weight)
    assert got.filter("n_tokens = 0 or taken = 0").count() == 0 and got.count() > 0
    assert mixing.mixed_documents(odd_docs, mixing.production_levels(), mixing.production_weight).count() == got.count()
    assert mixing.mix(no_docs, mixing.production_levels(), mixing.production_weight).count() == 0
    assert mixing.mixed_documents(no_docs, mixing.production_levels(), mixing.production_weight).count() == 0
