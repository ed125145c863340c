import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, epoch int, lang_pred string, keep_id long, _row string"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every awkward kind: null, empty, blank, tiny, very long, copies, near copies, shared passages, no Latin letter."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(40, 300)) for _ in range(12)]
    passage = " ".join(words(rng, 60))
    texts = [None, None, "", "", " \t\n", "one", "one two", "one  two", "ONE two", "a b c", "A b\tc", "½ 1234 !!!", "漢字かな交じり文 日本語 テキスト", "ÉCOLE école Ünï", "x" * 5000, "\x1cа б\x85в", "ab " * 400]
    for b in base:
        texts.append(" ".join(b))
        for edits in (1, 2, 4, 9, 30):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(["new", "word", "here", "x1"])
            texts.append(" ".join(c))
    texts += [" ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(8)]
    texts += [passage, passage + " " + passage, " ".join(words(rng, 20_000)), texts[20], texts[20], texts[40]]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts as documents, some rows twice, one id missing, with columns named like those that operators add."""
    langs, sources = ["en", "de", None], ["src0", "src0", "src1", "src2", None]
    rows = [(i, t, langs[i % 3], sources[i % 5], None if t is None else len(t), "k", i, 0, "zz", -1, "r") for i, t in enumerate(odd_texts)]
    rows += [rows[20], rows[30], rows[30]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
