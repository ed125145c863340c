"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from transitlake.llm import shared, token_ids  # noqa: E402

from test_ngram_join import brute as near_brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = shared.table(spark, SF, "documents")
    columns = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, shared.written(stage(spark, docs, SF), "stage")
        found[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = found["language ID"]
    assert not Counter(after) - Counter(before) and len(after) >= 0.99 * len(before)
    before, after = found["exact dedup"]
    last = {r.text: max(x.doc_id for x in before if x.text == r.text) for r in before}
    assert Counter(after) == Counter({r for r in before if last[r.text] == r.doc_id})
    before, after = found["n-gram join"]
    roots = {d: c for d, _, c in near_brute([(r.doc_id, r.text) for r in before])}
    assert Counter(after) == Counter(r for r in before if roots[r.doc_id] == r.doc_id)
    count = token_ids.encoder(token_ids.default_tokenizer()).encode
    tokens = lambda rows: sum(len(count(r.text or "")) // 4 for r in rows)
    before, after = found["mixing"]
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id].startswith(r.text) for r in after)
    leaves = len({(r.lang, r.source) for r in before})
    assert sum(r.text != texts[r.doc_id] for r in after) <= leaves
    assert abs(tokens(before) - tokens(after)) <= 3 * leaves  # each leaf to the token, and a cut text within a few of its tokens
    before, after = found["packing"]
    assert all(len(r.tokens) == r.n_tokens <= r.bin_size for r in after)
    assert sum(r.n_tokens for r in after) == tokens(before)
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_odd_rows_pass_all_stages(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF), "stage")
    assert docs.columns[:2] == ["doc_id", "piece"]


def test_run_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram join", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] > 0
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
