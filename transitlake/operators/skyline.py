"""Fronts of two costs, bands around them, and choices from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def front(df: DataFrame, keys: Sequence[str], time: str, fare: str, tie: str) -> DataFrame:
    """One row for each cost of the front: rows whose fare is under that of every row before them by time, fare, tie.

    The least fare of each time comes first, combined before the shuffle, so the sort sees one row a time.
    """
    rest = [c for c in df.columns if c not in (*keys, time, fare, tie)]
    least = df.groupBy(*keys, time).agg(F.min(F.struct(fare, tie, *rest)).alias("_b")).select(*keys, time, "_b.*")
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return least.withColumn("_m", F.min(fare).over(before)).filter(F.col("_m").isNull() | (F.col(fare) < F.col("_m"))).drop("_m")


def front_with_ties(df: DataFrame, keys: Sequence[str], time: str, fare: str, tie: str) -> DataFrame:
    """All rows of the front, those of equal costs included."""
    costs = front(df.select(*keys, time, fare, F.lit(0).alias("_t")), keys, time, fare, "_t").drop("_t")
    return df.join(costs, [*keys, time, fare], "left_semi")


def banded(df: DataFrame, keys: Sequence[str], time: str, fare: str, slack: int, margin: float) -> DataFrame:
    """tier 0 for the front's rows, 1 for others; rows are dropped that some row beats by more than slack in whole
    seconds and by margin or more in fare."""
    w = Window.partitionBy(*keys).orderBy(time)
    far = F.min(fare).over(w.rangeBetween(Window.unboundedPreceding, -slack - 1))
    faster = F.min(fare).over(w.rangeBetween(Window.unboundedPreceding, -1))
    equal = F.min(fare).over(Window.partitionBy(*keys, time))
    kept = df.withColumns({"_far": far, "_faster": faster, "_equal": equal}).filter(F.col("_far").isNull() | (F.col("_far") > F.col(fare) - margin))
    on = (F.col("_faster").isNull() | (F.col(fare) < F.col("_faster"))) & (F.col(fare) == F.col("_equal"))
    return kept.withColumn("tier", F.when(on, 0).otherwise(1)).drop("_far", "_faster", "_equal")


def least_by(df: DataFrame, keys: Sequence[str], cost: Column, tie: str) -> DataFrame:
    """The row of least cost of each key, ties by tie."""
    rest = [c for c in df.columns if c not in (*keys, tie)]
    return df.withColumn("cost", cost).groupBy(*keys).agg(F.min(F.struct("cost", tie, *rest)).alias("_b")).select(*keys, "_b.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, with rank, and truncated if there were more."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= n + 1)
    return ranked.withColumn("truncated", F.max("rank").over(w) > n).filter(F.col("rank") <= n)


def plan(candidates: DataFrame, baselines: DataFrame, key: str, min_saving_s: float, per_minute: float) -> DataFrame:
    """The candidates(key, id, time_s, fare) worth showing against each key's fastest baseline.

    The baseline is the fastest, then cheapest, an unknown fare last. Candidates stay that save min_saving_s, and of
    these the front. won_per_minute is what a saved minute costs more; recommended says that it is within per_minute.
    """
    fast = F.struct("time_s", F.col("fare").isNull().alias("unknown"), "fare")
    base = baselines.groupBy(key).agg(F.min(fast).alias("b")).select(key, F.col("b.time_s").alias("base_s"), F.col("b.fare").alias("base_fare"))
    saving = candidates.join(base, key).filter(F.col("base_s") - F.col("time_s") >= min_saving_s)
    shown = front(saving, [key], "time_s", "fare", "id")
    price = (F.col("fare") - F.col("base_fare")) / ((F.col("base_s") - F.col("time_s")) / 60)
    return shown.select(key, "id", "time_s", "fare", price.alias("won_per_minute"), F.coalesce(price <= per_minute, F.lit(False)).alias("recommended"))


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that a key has most often, ties the one first seen."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("_n"), "_o", value)).alias("b")).select(key, F.col(f"b.{value}").alias(value))


def first_usable(df: DataFrame, keys: Sequence[str], usable: Column, priority: Column, tie: str) -> DataFrame:
    """Of each key the first source in order of priority that is usable, else the first there is."""
    rest = [c for c in df.columns if c not in (*keys, tie)]
    pick = F.struct(F.when(usable, 0).otherwise(1).alias("_u"), priority.alias("_p"), tie, *rest)
    return df.groupBy(*keys).agg(F.min(pick).alias("_b")).select(*keys, tie, *[f"_b.{c}" for c in rest]) if tie in keys else df.groupBy(*keys).agg(F.min(pick).alias("_b")).select(*keys, f"_b.{tie}", *[f"_b.{c}" for c in rest])
