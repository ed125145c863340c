"""Operator 4: exact deduplication through an extendible-hash index on shared files (DataFrame functions only).

A text's key is a 64-bit hash; its top bits are its place in the directory. Rows go to the task that owns their range
of keys, which groups copies by their bytes, chains texts whose keys collide, and writes its buckets in key order.
Every row then looks its text up in the buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Distinct keys, and bytes of text, that a bucket holds before it is split.
BUCKET_KEYS, BUCKET_BYTES = 20_000, 64_000_000
#: Keys with more than this part of all rows, so fewer than this many, have their copies combined before the shuffle.
HOT_PART = 4_096
#: Split slots that are broadcast; more of them are joined with a shuffle. A good hash has none.
BROADCAST_SLOTS = 100_000
#: Keys that agree in so many bits stay in one bucket.
MAX_DEPTH = 63


def top_bits(key: Column, depth: int | Column) -> Column:
    below = F.lit(63) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(key, 1), below.cast("int"))


def directory(keys: DataFrame, distinct: int, n_bytes: int, bucket_keys: int = BUCKET_KEYS) -> tuple[int, DataFrame]:
    """The depth to which the directory doubles for all keys, and slot, local: the depth of the slots that need more.

    The common depth comes from counts, so that a bucket of a uniform hash is at most nine tenths full. Slots that
    hold more than bucket_keys of keys(key) all the same are split again and again until their buckets fit.
    """
    need = max(distinct / (0.9 * bucket_keys), n_bytes / BUCKET_BYTES, 1.0)
    depth = min(MAX_DEPTH, math.ceil(math.log2(need)))
    left = keys.select("key", top_bits(F.col("key"), depth).alias("slot"))
    found, local = None, depth
    while local < MAX_DEPTH:
        over = left.groupBy("slot", top_bits(F.col("key"), local).alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_keys).select("slot").distinct()
        over = shared.written(over, "dedup-overfull")
        if over.isEmpty():
            break
        local += 1
        step = over.withColumn("local", F.lit(local))
        found = step if found is None else found.unionByName(step)
        left = left.join(over, "slot", "left_semi")
    if found is None:
        found = shared.rows_of(keys.sparkSession, [], "slot long, local int")
    return depth, found.groupBy("slot").agg(F.max("local").alias("local"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """The documents with their keys, and the index: one entry per distinct text.

    The task that owns a range of keys groups its rows by key and bytes. Texts that share a key but differ in bytes
    are chained: chain numbers them, chain_length says how many there are. Copies under a key of very many rows are
    combined before they are sent. Buckets lie in shared files, each in one, in the order of keys.
    """
    key = F.xxhash64("text") if key is None else key
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), shared.text_of(text_col).alias("text")).withColumn("key", key.cast("long"))
    keys = shared.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text").cast("long")).alias("bytes")), "dedup-keys")
    all_ = keys.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    depth, deeper = directory(keys, all_.distinct, all_.bytes, bucket_keys)
    hot = keys.filter(F.col("n") > max(1, all_.rows // HOT_PART)).select(F.col("key").alias("hot_key"))
    marked = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    single = marked.filter("hot_key is null").select("key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    copies = marked.filter("hot_key is not null").groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slot = top_bits(F.col("key"), depth)
    placed = single.unionByName(copies).withColumn("slot", slot)
    few = deeper.limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS
    placed = placed.join(F.broadcast(deeper) if few else deeper, "slot", "left").withColumn("local", F.coalesce("local", F.lit(depth)))
    owned = placed.withColumns({"owner": F.col("slot").cast("int"), "bucket": top_bits(F.col("key"), F.col("local"))}).repartitionById(1 << depth, "owner")
    bucket = ["owner", "local", "bucket", "key"]
    grouped = owned.groupBy(*bucket, "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chained = Window.partitionBy(*bucket)
    entries = grouped.select(*bucket, F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size").withColumns(
        {"chain": F.row_number().over(chained.orderBy("text_sha256")), "chain_length": F.count(F.lit(1)).over(chained)}
    )
    return rows, shared.written(entries, "dedup-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chain.

    A null text counts as empty. Of equal texts the row with the largest id stays; null ids sort lowest. Rows that
    repeat both id and text are counted in group_size and share one decision. An empty table gives no rows. Other
    columns are not read, so their names can't clash.
    """
    rows, index = build_index(docs, id_col, text_col, key, bucket_keys)
    facts = index.select(F.col("key").alias("k"), F.col("text_sha256").alias("sha"), "keep_id", "group_size", "chain")
    mine = rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))
    return mine.join(facts, (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("sha"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "chain"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, that of the largest id, with all its columns; of rows that repeat id and text one stays."""
    _, index = build_index(docs, id_col, text_col)
    least = F.lit(-(1 << 63)).cast("long")
    keep = index.select(F.col("text_sha256").alias("sha"), F.col("keep_id").isNull().alias("no_id"), F.coalesce(F.col("keep_id").cast("long"), least).alias("id"))
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = shared.carried(docs, sha=F.sha2(shared.text_of(text_col), 256), no_id=doc_id.isNull(), id=F.coalesce(doc_id, least))
    by = ["sha", "no_id", "id"]
    return shared.first_of(rows.join(keep, by, "left_semi"), by).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.table(spark, sf_dir, "documents")).drop("chain")


SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.t
"""
