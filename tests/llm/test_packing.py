import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transitlake.llm import packing


def check(rows, lengths, sizes):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
        pieces[r.doc_id].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        used = sum(r.n_tokens for r in members)
        assert {r.bin_size for r in members} == {min(s for s in sizes if s >= used)}
        assert [r.bin_offset for r in members] == [sum(x.n_tokens for x in members[:i]) for i in range(len(members))]
    for doc, n in lengths.items():
        mine = sorted(pieces.get(doc, []), key=lambda r: r.piece)
        assert sum(r.n_tokens for r in mine) == n
        assert [r.first_token for r in mine] == [max(sizes) * i for i in range(len(mine))]
    assert set(pieces) == {d for d, n in lengths.items() if n}
    return bins


@pytest.mark.parametrize("block", [100_000, 40])
def test_bins_hold_every_token_once(spark, block):
    rng = random.Random(1)
    lengths = {i: rng.choice([0, 1, 16, 17, rng.randint(1, 60), 64, 200]) for i in range(400)}
    df = spark.createDataFrame([(i, n, "x") for i, n in lengths.items()], "doc_id long, n int, bin string")
    rows = packing.pack(df, F.col("n"), (16, 32, 64), block=block).collect()
    bins = check(rows, lengths, (16, 32, 64))
    if block > 1000:
        assert sum(lengths.values()) >= 0.9 * sum(m[0].bin_size for m in bins.values())


def test_best_fit_choices():
    where, cut = packing.best_fit([50, 30, 14, 2], (16, 64), price=lambda s: s)
    assert where[0] == where[2] and where[1] == where[3]  # 14 fills the bin of 50
    assert cut == [64, 64]
    assert packing.best_fit([10, 10], (16, 64), price=lambda s: s)[1] == [16, 16]  # cheaper than one of 64
    assert packing.best_fit([10, 10], (16, 64), price=lambda s: 100 + s)[1] == [64]  # the fixed part decides
    assert packing.best_fit([5], (8, 64), price=lambda s: s)[1] == [8]  # cut down to its contents
    assert packing.best_fit([], (8, 64)) == ([], [])


def test_never_dearer_than_one_size():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 64) for _ in range(60)), reverse=True)
        joint = sum(map(packing.cost, packing.best_fit(lengths, (16, 32, 64))[1]))
        assert joint <= sum(map(packing.cost, packing.best_fit(lengths, (64,))[1]))


def naive(lengths, sizes, price):
    """Best fit by looking at every open bin, for every range of the sizes that are opened."""
    runs = []
    for low, high in [(a, b) for a in sizes for b in sizes if a <= b]:
        bins = []
        for n in lengths:
            fits = [b for b in bins if b[0] - sum(b[1]) >= n]
            if fits:
                best = min(fits, key=lambda b: (b[0] - sum(b[1])))
            else:
                fitting = [s for s in sizes if s >= n and low <= s <= high] or [min(s for s in sizes if s >= n)]
                best = (min(fitting, key=lambda s: (price(s) / s, -s)), [])
                bins.append(best)
            best[1].append(n)
        runs.append(sum(price(min(s for s in sizes if s >= sum(b[1]))) for b in bins))
    return min(runs), runs


@pytest.mark.parametrize("price", [packing.cost, lambda s: s, lambda s: 40 + s])
def test_cost_is_that_of_plain_best_fit(price):
    rng = random.Random(8)
    differ = 0
    for _ in range(60):
        sizes = (512, 1024, 2048, 4096)
        lengths = sorted((rng.choice([rng.randint(1, 400), rng.randint(300, 700), rng.randint(1, 4096)]) for _ in range(rng.randint(1, 60))), reverse=True)
        where, cut = packing.best_fit(lengths, sizes, price)
        best, runs = naive(lengths, sizes, price)
        assert abs(sum(map(price, cut)) - best) < 1e-6
        used = [sum(n for n, w in zip(lengths, where) if w == b) for b in range(len(cut))]
        assert all(u <= c for u, c in zip(used, cut))
        differ += len({round(r, 3) for r in runs}) > 2
    assert differ > 10  # the limits really compete


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 3), (None, 4), (big + 2, 5)], "doc_id long, n int").coalesce(1)
    assert {(r.doc_id, r.n_tokens) for r in packing.pack(df, F.col("n")).collect()} == {(big, 3), (None, 4), (big + 2, 5)}


def test_sequences_hold_the_tokens(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    from transitlake.llm import token_ids

    library = Tokenizer.from_file(token_ids.default_tokenizer())
    rows = odd_docs.collect()
    want = Counter(r.doc_id for r in rows)
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    got = packing.pack_tokens(odd_docs, sizes=(64, 256)).collect()
    pieces = defaultdict(list)
    for r in got:
        assert len(r.tokens) == r.n_tokens <= 256
        pieces[r.doc_id].append(r)
    for doc, ids in texts.items():
        if want[doc] == 1:
            mine = sorted(pieces[doc], key=lambda r: r.piece)
            assert [t for r in mine for t in r.tokens] == ids and [r.first_token for r in mine] == [256 * i for i in range(len(mine))]
    assert sum(r.n_tokens for r in got) == sum(len(texts[r.doc_id]) for r in rows)
    bins = defaultdict(int)
    for r in got:
        bins[r.bin, r.bin_size] += r.n_tokens
    assert all(size == min(s for s in (64, 256) if s >= used) for (_, size), used in bins.items())
    assert packing.pack_tokens(no_docs).count() == 0


@pytest.mark.parametrize("letter", ["x", "漢"])
def test_a_text_without_blanks_is_cut(spark, letter):
    docs = spark.createDataFrame([(1, letter * 300_000), (2, "a b c")], "doc_id long, text string")
    got = packing.pack_tokens(docs).collect()
    assert max(r.bin_size for r in got) == 8192 and all(r.n_tokens <= 8192 for r in got)
    assert sum(r.doc_id == 1 for r in got) == -(-sum(r.n_tokens for r in got if r.doc_id == 1) // 8192) > 3


def word_count(text="text"):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def test_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs, word_count())
    assert got.agg(F.sum("n_tokens")).first()[0] == odd_docs.agg(F.sum(word_count())).first()[0]
    assert packing.pack(no_docs, word_count()).count() == 0
    assert packing.pack(odd_docs, F.lit(None)).count() == 0
