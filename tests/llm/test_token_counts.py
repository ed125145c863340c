import pytest
from tokenizers import Tokenizer

from transitlake.llm import token_counts

TEXTS = ["a<|endoftext|>b  <|endoftext|>", " \x1c \x85 x  y\r\n\r\n  z", "'s 'S don't I'LL we've", "́a١٢ ½ ²", "😀😀 👨‍👩‍👧", " " * 1000, "a" * 20_000, "᠎ ​﻿", "x\n\n  \n y \t", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a\x00b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_counts_are_the_librarys(spark, library, odd_docs):
    rows = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(TEXTS, 1000)), "doc_id long, text string"))
    got = token_counts.token_counts(rows.withColumnRenamed("doc_id", "n_tokens").withColumnRenamed("text", "n_bytes"), id_col="n_tokens", text_col="n_bytes")
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.collect())


def test_whole_tokens_are_proved(library):
    counter = token_counts.counter(token_counts.default_tokenizer())
    assert len(counter.whole) > 40_000
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(counter.whole)[::97])


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 5)
    counter = token_counts.WholeTokenCounter(token_counts.default_tokenizer())
    text = " ".join(f"qz{i}xk" for i in range(50))
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(counter.memo) <= 5


def test_no_rows(no_docs):
    assert token_counts.token_counts(no_docs).count() == 0


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.n_bytes) for r in token_counts.token_counts(df).collect()} == {(big, 3), (None, 1), (big + 2, 0)}
