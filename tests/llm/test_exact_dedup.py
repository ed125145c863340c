import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transitlake.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return Counter((r.doc_id, max(g), len(g), r.doc_id == max(g), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows for g in [groups[r.text or ""]])


@pytest.mark.parametrize("key", [None, "length(text) % 3", "7L"], ids=["hash", "chains", "one chain"])
def test_groups_of_equal_bytes(odd_docs, key):
    got = exact_dedup.exact_dedup(odd_docs, key=key and F.expr(key), bucket_keys=4)
    assert Counter(map(tuple, got.drop("chain").collect())) == expected(odd_docs.collect())


def test_kept_rows_are_whole(odd_docs):
    kept = exact_dedup.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.collect()
    last = {r.text or "": max(x.doc_id for x in rows if (x.text or "") == (r.text or "")) for r in rows}
    assert Counter(kept.collect()) == Counter({r for r in rows if last[r.text or ""] == r.doc_id})


def test_null_ids_and_no_rows(spark, no_docs):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect())
    assert got == Counter({(None, 3, 3, False): 2, (3, 3, 3, True): 1, (None, None, 1, True): 1})
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.kept_documents(no_docs).count() == 0


def test_one_row_of_each_text_stays(spark):
    big = 2**53 + 1
    rows = [(1, "a"), (1, "a"), (big, "b"), (None, "b"), (None, "c"), (None, "c"), (0, None), (0, ""), (big, "d"), (big, "d")]
    kept = exact_dedup.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter([(1, "a"), (big, "b"), (None, "c"), (0, ""), (big, "d")])


def test_directory_doubles_and_splits(spark):
    even = spark.range(1000).select(F.xxhash64("id").alias("key"))
    depth, deeper = exact_dedup.directory(even, 1000, 0, bucket_keys=100)
    fill = Counter(r[0] for r in even.select(exact_dedup.top_bits(F.col("key"), depth)).collect())
    assert depth == 4 and {r.slot for r in deeper.collect()} == {s for s, n in fill.items() if n > 100}
    crowded = spark.range(40).select((F.col("id") * (1 << 50)).alias("key"))  # all under one slot of a shallow directory
    depth, deeper = exact_dedup.directory(crowded, 40, 0, bucket_keys=5)
    for slot, local in deeper.collect():
        held = Counter(r[0] for r in crowded.filter(exact_dedup.top_bits(F.col("key"), depth) == slot).select(exact_dedup.top_bits(F.col("key"), local)).collect())
        assert max(held.values()) <= 5 and local > depth
    assert deeper.count() >= 1
    assert exact_dedup.directory(even.limit(0), 0, 0)[0] == 0


def test_an_owner_holds_whole_buckets_in_key_order(odd_docs):
    """Each bucket lies in one file; a file's keys are one range."""
    _, index = exact_dedup.build_index(odd_docs, bucket_keys=4)
    files = index.select("owner", "bucket", "local", F.input_file_name().alias("f")).distinct().collect()
    assert len({f.owner for f in files}) > 1 and len({f.f for f in files}) == len({f.owner for f in files})
    assert all(f.bucket >> (f.local - files_depth) == f.owner for files_depth in [min(x.local for x in files)] for f in files)


def test_no_python_on_the_main_path(odd_docs):
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
