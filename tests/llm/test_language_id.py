import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.llm import language_id


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.train(docs)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, model).filter(language_id.held_out()).select("doc_id", "lang", "lang_pred", "score", "rejected").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    known = [r for r in rows if r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known)
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in known if r.lang == r.lang_pred)


def test_rejects_what_no_model_expects(spark, model):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("qxzjkwvpñß") for _ in range(9)) for _ in range(200))
    df = spark.createDataFrame([(1, noise), (2, "漢字かな交じり文 " * 40)], "doc_id long, text string")
    assert all(r.rejected for r in language_id.identify(df, model).collect())


def test_texts_without_letters(spark, model, odd_docs, no_docs):
    rows = language_id.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) | {"score", "rejected"} == set(rows[0].asDict())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.langs) if letters else (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert language_id.identify(no_docs, model).count() == 0
    none = language_id.train(no_docs)
    assert none is None
    assert {r.lang_pred for r in language_id.identify(odd_docs, none).collect()} == {"und"}


def test_predictions_ignore_everything_but_the_text(spark, model, odd_docs):
    a = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd_docs, model).collect()}
    other = odd_docs.withColumns({"lang": F.lit("es"), "source": F.lit("q")})
    assert {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(other, model).collect()} == a


def test_probabilities_sum_to_one_over_what_can_follow():
    counts = {"a": {"abba": 3, "baab": 2, "ab": 5}, "b": {"bbb": 4, "ba": 1}}
    model = language_id.KneserNey(counts)
    alphabet = ["a", "b", " "]
    # P(x | context) for the context of the first character of a word: all that training saw, and the share of the unseen.
    for j in range(2):
        total = 0.0
        for c in ("a", "b"):
            one, _ = model.log_probabilities([c])
            two, _ = model.log_probabilities([c + "a"])
            end = two[0][j] - one[0][j]  # differs by what follows only
            assert np.isfinite(end)
        codes = np.array([32, 32, 32, 32], dtype=np.uint64)
        p = []
        for c in alphabet:
            seq = np.concatenate([codes, [np.uint64(ord(c))]]).astype(np.uint64)
            value = language_id.UNSEEN
            for k in range(1, language_id.ORDER + 1):
                ctx, weights = model.contexts[k]
                i, hit = model.find(ctx, language_id.gram_hashes(seq, np.array([3]), k - 1) if k > 1 else np.zeros(1, dtype=np.uint64))
                value = value * weights[i[0], j] if hit[0] else value
                grams, values = model.grams[k]
                i, hit = model.find(grams, language_id.gram_hashes(seq, np.array([4]), k))
                value = values[i[0], j] if hit[0] else value
            p.append(float(value))
        total = sum(p)
        assert 0.95 < total <= 1.0001
    assert model.langs == ["a", "b"]


def plain_kneser_ney(words, order):
    """P(c | context) of interpolated Kneser-Ney by its definition, with recursion and dictionaries only."""
    from collections import Counter

    grams = {order: Counter()}
    for w, n in words.items():
        s = " " * (order - 1) + w + " "
        for i in range(len(w) + 1):
            grams[order][s[i : i + order]] += n
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return language_id.UNSEEN
        c = grams[k]
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        of = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not of:
            return p(gram[1:])
        total = sum(of.values())
        return max(of.get(gram, 0) - d, 0) / total + d * len(of) / total * p(gram[1:])

    return p


def test_scores_are_those_of_plain_kneser_ney():
    counts = {"a": {"abba": 3, "baab": 2, "ab": 5, "cab": 1}, "b": {"bbb": 4, "ba": 1, "zé": 1}}
    model = language_id.KneserNey(counts)
    words = ["ab", "abba", "zz", "bbbb", "cabab", "é", "qab"]
    scores, n = model.log_probabilities(words)
    for w, row in zip(words, scores):
        s = " " * (language_id.ORDER - 1) + w + " "
        for j, lang in enumerate(model.langs):
            p = plain_kneser_ney(counts[lang], language_id.ORDER)
            want = sum(np.log(p(s[i : i + language_id.ORDER])) for i in range(len(w) + 1))
            assert np.isclose(row[j], want, rtol=1e-4)
    assert n.tolist() == [len(w) + 1 for w in words]


def test_wrong_labels_do_not_end_rejection():
    model = language_id.KneserNey({"a": {"abba": 3}, "b": {"bbb": 4}})
    rng = np.random.default_rng(2)
    cross = np.stack([rng.normal(2, 0.1, 300), rng.normal(6, 0.1, 300)], axis=1)
    cross[0] = [11.0, 2.0]  # one document of b under the label a
    n = np.full(300, 10_000)
    model.calibrate(cross, n, np.zeros(300, dtype=int))
    assert model.limits[0] < 4
    best, _, out = model.judge(np.array([[2.1, 6.0], [5.0, 6.0]]), np.array([10_000, 10_000]))
    assert best.tolist() == [0, 0] and out.tolist() == [False, True]


def test_rare_labels_give_way(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, "aba abab " * (9 - i % 3), f"l{i % 3}") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["l0", "l1"]


def test_long_texts_go_past_the_memo(monkeypatch, model):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    whole, n = language_id.Scorer(model).cross_entropies([text, "la la", None or ""])
    monkeypatch.setattr(language_id, "MEMO", 500)
    small, m = language_id.Scorer(model).cross_entropies([text, "la la", ""])
    assert np.allclose(whole, small) and (n == m).all() and n[2] == 0
