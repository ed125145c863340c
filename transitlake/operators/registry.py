"""Cleaning, merging and checking of registries from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.functions import names
from transitlake.operators import spatial
from transitlake.plans.storage import settled

NEAR_M, FAR_M = 50.0, 300.0


def decision(dist_m: Column, key_a: Column, key_b: Column, override: Column | None = None) -> Column:
    """override, else near within 50 m, far within 300 m if the names fit, else split."""
    plain = F.when(dist_m <= NEAR_M, "merged_near").when((dist_m <= FAR_M) & names.compatible(key_a, key_b), "merged_far").otherwise("split")
    return plain if override is None else F.coalesce(override, plain)


def merges(things: DataFrame, same: Sequence[str]) -> DataFrame:
    """id_a, id_b, decision: all pairs of things(id, key, lon, lat, *same) that agree in same and merge, id_a < id_b.

    A thing that merges with none has one row, with split and no id_b. Any other pair is split by decision, as it lies
    further apart than FAR_M or its names don't fit, so the pairs of a group are not all made.
    """
    a = things.select(*same, F.col("id").alias("id_a"), F.col("key").alias("key_a"), "lon", "lat")
    b = things.select(*same, F.col("id").alias("id_b"), F.col("key").alias("key_b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    met = spatial.grid_join(a, b, FAR_M, on=same).filter("id_a < id_b")
    merged = settled(met.select("id_a", "id_b", decision(F.col("dist_m"), F.col("key_a"), F.col("key_b")).alias("decision")).filter("decision <> 'split'"), "merged")
    # Pairs of copies are many in small files, which Spark would take for a small table and broadcast.
    partnered = merged.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    alone = things.select("id").join(partnered.hint("merge"), "id", "left_anti")
    return merged.unionByName(alone.select(F.col("id").alias("id_a"), F.lit(None).cast(merged.schema["id_b"].dataType).alias("id_b"), F.lit("split").alias("decision")))


def first_match(rows: DataFrame, candidates: DataFrame, on: str, accept: Column, id_col: str, order: Sequence[str]) -> DataFrame:
    """Each row with the first of its candidates that accept takes; rows without one keep nulls.

    Candidates of one key are few versions of one thing.
    """
    met = rows.join(candidates, on).filter(accept)
    best = met.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter("_rn = 1").drop("_rn")
    added = [c for c in candidates.columns if c != on]
    return rows.join(best.select(id_col, *added), id_col, "left")


def first_above(rows: DataFrame, candidates: DataFrame, on: str, value: str, bar: str, id_col: str, first: str) -> DataFrame:
    """Each row(id_col, on, value) with the candidate(on, first, bar) of least first whose bar is over its value; null without one.

    Only a candidate whose bar is over those of all before it can be the first. Their bars rise with first, so a row takes
    that with the least bar over its value, found by one sort of both, and no pairs are made.
    """
    usable = candidates.filter(F.col(on).isNotNull() & F.col(bar).isNotNull()).groupBy(on, bar).agg(F.min(first).alias(first))

    def rising(df: DataFrame, *by: Column | str) -> DataFrame:
        before = F.max(bar).over(Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(bar) > F.col("_before"))).drop("_before")

    # Who is passed within a part of a key is passed within the key, so few are left for the key's own sort.
    steps = rising(rising(usable, on, F.pmod(F.xxhash64(first), F.lit(64))), on)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    asks = rows.select(on, F.col(value).alias("_v"), F.lit(0).alias("_step"), id_col, none(candidates, first))
    both = asks.unionByName(steps.select(on, F.col(bar).alias("_v"), F.lit(1).alias("_step"), none(rows, id_col), first))
    down = Window.partitionBy(on).orderBy(F.col("_v").desc(), "_step").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_found", F.when(F.col("_v").isNotNull(), F.last(first, ignorenulls=True).over(down))).filter("_step = 0")
    return found.select(id_col, F.col("_found").alias(first))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a registry passes if there is none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lost(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of before that after lacks."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raises with an example if there is a violation."""
    if (bad := violations.limit(3).collect()):
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def mapped(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df with the columns of a code table; an unknown code fails the job."""
    met = df.join(mapping.withColumn("_known", F.lit(True)), key, "left")
    return met.filter(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).drop("_known")


def refreshed(old: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str], keep_gone: Column) -> DataFrame:
    """old brought up to date by fresh: new, both (fresh fields win) and those gone that keep_gone keeps; status says which."""
    a = old.select(key, *[F.col(f).alias(f"_o{f}") for f in fields], F.lit(True).alias("_old"))
    b = fresh.select(key, *[F.col(f).alias(f"_n{f}") for f in fields], F.lit(True).alias("_new"))
    met = a.join(b, key, "full_outer")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").otherwise("both")
    out = met.select(key, *[F.coalesce(f"_n{f}", f"_o{f}").alias(f) for f in fields], status.alias("status"))
    return out.filter((F.col("status") != "gone") | keep_gone)


def ordered_values(df: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """The different values of a key joined by |, in the order they first stand in."""
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    return got.select(key, F.array_join(F.array_distinct(F.transform("_v", lambda x: x[value])), "|").alias(name))


def fallback_join(df: DataFrame, key: str, tables: Sequence[tuple[DataFrame, str]], value: str) -> DataFrame:
    """value from the first of several lookups that has the key."""
    out = df
    for i, (t, column) in enumerate(tables):
        out = out.join(t.select(F.col(column).alias(key), F.col(value).alias(f"_f{i}")).dropDuplicates([key]), key, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_f{i}") for i in range(len(tables))])).drop(*[f"_f{i}" for i in range(len(tables))])


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], other: str | None = None) -> DataFrame:
    """Counts by row of the values of a column; with other, all else, null included, in a column of that name."""
    if other is None:
        return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    kept = F.when(F.col(column).isin(*values), F.col(column)).otherwise(other)
    return df.select(row, kept.alias("_kept")).groupBy(row).pivot("_kept", [*values, other]).count().na.fill(0)


def live_names(stations: DataFrame, live: DataFrame, overrides: DataFrame) -> DataFrame:
    """stations(station_id, line_id, names array) with the name of live(line_id, live_name) to ask by, and how it was found.

    An override(station_id, live_name) comes first, then the station's own name, then its other names in their order.
    """
    tried = stations.select("station_id", "line_id", F.posexplode("names").alias("i", "name")).withColumn("key", names.name_key(F.col("name"), station=True))
    known = live.select("line_id", "live_name", names.name_key(F.col("live_name"), station=True).alias("key"))
    hit = tried.join(known, ["line_id", "key"]).groupBy("station_id").agg(F.min(F.struct("i", "live_name")).alias("b"))
    given = overrides.select("station_id", F.col("live_name").alias("given"))
    out = stations.join(given, "station_id", "left").join(hit, "station_id", "left")
    how = F.when(F.col("given").isNotNull(), "override").when(F.col("b.i") == 0, "exact").when(F.col("b").isNotNull(), "alias").otherwise("none")
    return out.select("station_id", F.coalesce("given", "b.live_name").alias("live_name"), how.alias("match"))


def freshness(df: DataFrame, key: str, date: Column, stale: str) -> DataFrame:
    """first, last, and how many dates of a key are stale or missing."""
    return df.withColumn("_d", date).groupBy(key).agg(F.min("_d").alias("first"), F.max("_d").alias("last"), F.count_if(F.col("_d") < F.lit(stale).cast("date")).alias("stale"), F.count_if(F.col("_d").isNull()).alias("missing"))
