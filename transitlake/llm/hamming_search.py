"""Operator 2: exact top-k search in binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

K = 10
BITS = 64
#: Segments are no wider, however many codes there are, so the masks of one radius, which are broadcast, are at most 705,432 a width.
MAX_WIDTH = 22


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The signs of up to 64 numbers as bits, the first lowest: 1 above zero, 0 otherwise. Null for a null vector."""
    bit = F.zip_with(vector, F.sequence(F.lit(0), F.lit(bits - 1)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n segments of nearly equal width."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _parts(code: Column, cut: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("part"), F.lit(w).alias("width")) for i, (a, w) in enumerate(cut)]))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """query_id, rank, neighbor_id, distance: for each row of queries(id, code) the k rows(id, code) of least Hamming
    distance, ties by id. A query that is itself a row is found like any other.

    Segment radius s finds every code that differs by at most s in some segment, so all codes within n * (s + 1) - 1
    of n segments. Queries whose kth distance is within that are done; the others go on to radius s + 1, where only
    the new values of each segment are looked up. Each distinct code keeps its k least ids, which is exact. Rows or
    queries whose code or id is null are passed over; repeated rows count once. Fewer than k rows: all of them.
    """
    spark = rows.sparkSession
    of_code = Window.partitionBy("code").orderBy("id")
    codes = rows.select("id", "code").filter("id is not null and code is not null").distinct().withColumn("r", F.row_number().over(of_code)).filter(F.col("r") <= k)
    codes = shared.written(codes.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    counts = codes.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    needed = min(k, counts.ids)
    n = max(1, min(bits, math.ceil(bits / min(MAX_WIDTH, math.log2(max(2, counts.codes))))))
    cut = segments(bits, n)
    index = shared.written(codes.select("code", "ids", _parts(F.col("code"), cut).alias("p")).select("p.seg", "p.part", "code", "ids").repartition("seg", "part"), "segment-index")
    asked = shared.written(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).filter("query_id is not null and query_code is not null").distinct().withColumn("bound", F.lit(bits)), "queries")
    done, found, open_ = None, None, asked
    distance = F.bit_count(F.col("query_code").bitwiseXOR(F.col("code"))).cast("int")
    for s in range(max(w for _, w in cut) + 1):
        if not needed or open_.isEmpty():
            break
        flips = [(w, sum(1 << b for b in bits_)) for w in {w for _, w in cut} if w >= s for bits_ in combinations(range(w), s)]
        masks = spark.createDataFrame(flips, "width int, mask long")
        probes = open_.select("query_id", "query_code", "bound", _parts(F.col("query_code"), cut).alias("p")).select("query_id", "query_code", "bound", "p.*")
        probes = probes.join(F.broadcast(masks), "width").select("query_id", "query_code", "bound", F.col("seg").alias("s"), F.col("part").bitwiseXOR(F.col("mask")).alias("p"))
        near = (F.col("s") == F.col("seg")) & (F.col("p") == F.col("part")) & (distance <= F.col("bound"))
        met = probes.join(index, near).select("query_id", F.explode("ids").alias("neighbor_id"), distance.alias("distance"))
        met = met if found is None else met.unionByName(found.join(open_.select("query_id"), "query_id", "left_semi"))
        order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        best = met.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = shared.written(best, "found")
        covered = n * (s + 1) - 1
        state = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
        finished = state.filter((F.col("n") >= needed) & (F.col("d") <= covered)).select("query_id")
        closed = ranked.join(finished, "query_id", "left_semi")
        done = closed if done is None else done.unionByName(closed)
        found = ranked.drop("rank")
        # What is found later counts only within the kth distance so far.
        bound = F.when(F.col("n") >= needed, F.col("d")).otherwise(bits)
        left = open_.drop("bound").join(finished, "query_id", "left_anti").join(state, "query_id", "left")
        open_ = shared.written(left.select("query_id", "query_code", F.coalesce(bound, F.lit(bits)).alias("bound")), "open")
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    return done.select("query_id", "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = shared.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(coded, coded.filter("id % 50 = 0"))


SQL = """
WITH bits AS (
  SELECT vec_id, i, CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END AS b
  FROM embeddings, range(1, 65) AS r(i) WHERE embedding IS NOT NULL
), codes AS (
  SELECT vec_id, string_agg(b, '' ORDER BY i)::BIT AS code FROM bits GROUP BY vec_id
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q, codes c WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INTEGER AS rank, neighbor_id, distance FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
