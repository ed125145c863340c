"""What Python workers and tasks hold: batches, splits, what is left between tasks, kinds of workers."""

import math

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from transitlake.llm import exact_dedup, language_id, ngram_join, shared  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_a_lean_task_drops_what_others_left(monkeypatch):
    shared.held(("tables", 1), dict)
    seen = []
    got = list(shared.lean(lambda batches: (seen.append(dict(shared._HELD)) or b for b in batches))(iter([1, 2])))
    assert got == [1, 2] and seen == [{}, {}]


def test_few_rows_need_no_python_workers(spark):
    rows = [("en", 1 << 53), ("d'e", 3), ("", -1)]
    made = shared.rows_of(spark, rows, "lang string, cut long")
    assert [tuple(r) for r in made.collect()] == rows and made.dtypes == [("lang", "string"), ("cut", "bigint")]
    none = shared.rows_of(spark, [], "slot long, local int")
    assert none.collect() == [] and none.dtypes == [("slot", "bigint"), ("local", "int")]
    docs = shared.table(spark, SF, "documents")
    keys = docs.select(F.xxhash64("text").alias("key"))
    for df in (made, none, language_id.training_sample(docs), exact_dedup.directory(keys, 10, 10)[1]):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_judged_in_small_batches(spark, monkeypatch):
    """However the stage's result is read, workers get BATCH_ROWS rows at once."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(language_id, "train", lambda docs: None)

    def identify(docs, model):
        def judged(batches):
            for b in batches:
                seen.add(1)
                yield b

        return docs.withColumns({"lang_pred": F.lit("en"), "rejected": F.lit(False)}).mapInArrow(judged, docs.withColumns({"lang_pred": F.lit("en"), "rejected": F.lit(False)}).schema)

    monkeypatch.setattr(language_id, "identify", identify)
    rows = 4 * shared.BATCH_ROWS
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("lang"))
    found = corpus_pipeline.identify_languages(spark, docs, SF)
    assert found.count() == rows and seen.value == math.ceil(rows / shared.BATCH_ROWS)


def test_sets_are_counted_in_small_splits(spark, monkeypatch):
    """Each task that explodes and counts sets reads SPLIT_BYTES, whatever the session has, which comes back after."""
    before, seen = spark.conf.get(shared._SPLIT), {}
    plain = shared.written

    def written(df, what, *args, **more):
        seen[what] = more.get("split_bytes")
        return plain(df, what, *args, **more)

    monkeypatch.setattr(shared, "written", written)
    rows = ngram_join._rows(shared.table(spark, SF, "documents"), "doc_id", "text")
    ngram_join.sequences(rows, ngram_join.file_sets(rows))
    assert {k for k, v in seen.items() if v == shared.SPLIT_BYTES} == {"ngram-near", "ngram-counts", "ngram-sequences"}
    assert spark.conf.get(shared._SPLIT) == before
    assert [shared._bytes(x) for x in ("134217728b", "16m", "16MB", "7", "1g")] == [1 << 27, 1 << 24, 1 << 24, 7, 1 << 30]
