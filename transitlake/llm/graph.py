"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rounds after which something is wrong; stars take about the logarithm of the longest path.
MAX_ROUNDS = 60


def _falling(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = _falling(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return _falling(large.join(least, "a").select("b", "m").toDF("a", "b").unionByName(least.toDF("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of edges(a long, b long) that isn't its own root.

    Each round joins every node with its least neighbour: minima are combined before the shuffle, and a node with
    very many edges is a skewed join that Spark splits. Rounds end in shared files.
    """
    now = shared.written(_falling(edges), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or mark == (state.n, state.h):
            return now.toDF("node", "root")
        mark = (state.n, state.h)
        now = shared.written(_star(now), "edges")
    raise RuntimeError("components did not settle")
