"""Headways, waits and service tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.functions import costs, times


def departures_by_hour(stop_times: DataFrame, keys: Sequence[str], minute: Column, terminal: Column) -> DataFrame:
    """n departures for each key and hour of the service day; where a trip ends is no departure."""
    return stop_times.filter(~F.coalesce(terminal, F.lit(False))).groupBy(*keys, F.floor(minute / 60).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def centred_headway(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """headway_m from the departures of an hour and its neighbours; hours without a row count none and get none."""
    w = Window.partitionBy(*keys).orderBy("hour").rangeBetween(-1, 1)
    n3 = hours.withColumn("n3", F.sum("n").over(w))
    return n3.withColumn("headway_m", F.round(F.lit(180.0) / F.col("n3"), 1))


def mean_known(low: Column, high: Column) -> Column:
    """The mean of what is known of two headways; zero and null are unknown."""
    known = F.filter(F.array(low.cast("double"), high.cast("double")), lambda x: x.isNotNull() & (x > 0))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def frequency_sum(routes: DataFrame, key: str, name: str, headway: str) -> DataFrame:
    """The headway of all routes of a key together: 1 / sum(1 / h), routes of one name being averaged first."""
    named = routes.filter(F.col(headway) > 0).groupBy(key, name).agg(F.avg(headway).alias("h"))
    return named.groupBy(key).agg((1 / F.sum(1 / F.col("h"))).alias("headway"), F.count(F.lit(1)).alias("names"))


def unpivot_days(wide: DataFrame, ids: Sequence[str], days: Mapping[str, str], fields: Sequence[str]) -> DataFrame:
    """A row for each day type of columns named prefix + field; rows with nothing known are left out."""
    parts = [F.struct(F.lit(day).alias("day_type"), *[F.nullif(F.trim(F.col(f"{prefix}{f}").cast("string")), F.lit("")).alias(f) for f in fields]) for day, prefix in days.items()]
    long = wide.select(*ids, F.explode(F.array(*parts)).alias("d")).select(*ids, "d.*")
    return long.filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


def running_clock(legs: DataFrame, key: str, start_minute: Column, headway_by_hour: Column) -> DataFrame:
    """The minutes of a journey whose waits depend on the hour of boarding, which depends on the waits before.

    legs(key, pos, ride_m, line): each leg waits half the headway of its line at the hour it is boarded, 15 minutes
    where it isn't known. headway_by_hour: a map of 'line:hour' to minutes, the same for all legs of a key.
    """
    steps = legs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ride_m", "line"))).alias("steps"), F.first(start_minute).alias("start"), F.first(headway_by_hour).alias("headways"))

    def take(acc: Column, s: Column) -> Column:
        hour = F.floor((acc["at"]) / 60).cast("int")
        wait = F.coalesce(F.try_element_at("headways", F.concat_ws(":", s["line"], hour.cast("string"))) / 2, F.lit(costs.DEFAULT_WAIT_S / 60.0))
        return F.struct((acc["at"] + wait + s["ride_m"]).alias("at"), (acc["wait"] + wait).alias("wait"))

    total = F.aggregate("steps", F.struct(F.col("start").cast("double").alias("at"), F.lit(0.0).alias("wait")), take)
    return steps.withColumn("t", total).select(key, F.col("t.at").alias("arrive_m"), F.col("t.wait").alias("wait_m"))


def skewed_directions(counts: DataFrame, key: str, direction: str, n: str) -> DataFrame:
    """Keys one of whose directions has more than twice the trips of another."""
    return counts.groupBy(key).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.count(direction).alias("directions")).filter("least * 2 < most")


def served(rows: DataFrame, minute: Column, first: Column, last: Column) -> DataFrame:
    return rows.filter(times.in_service(first, last, minute))


def trips_by_direction(stop_times: DataFrame, group: str, direction: str, trip: str) -> DataFrame:
    """trips, how many different ones each group has in each direction."""
    return stop_times.groupBy(group, direction).agg(F.count_distinct(trip).alias("trips"))


def peak_median(hours: DataFrame, key: str, headway: str, hour: int = 8) -> DataFrame:
    """peak_m, the median headway of a key at one hour; keys without it have no row."""
    return hours.filter((F.col("hour") == hour) & F.col(headway).isNotNull()).groupBy(key).agg(F.median(headway).alias("peak_m"))


def merged_directions(hours: DataFrame, keys: Sequence[str], headway: str) -> DataFrame:
    """The mean headway of all directions of the keys and hour; unknown ones don't count."""
    return hours.groupBy(*keys, "hour").agg(F.avg(headway).alias(headway))


def reason_counts(pairs: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """n pairs by the first of the reasons that holds against them; those that none holds against have null."""
    first = F.coalesce(*[F.when(holds, name) for name, holds in reasons.items()])
    return pairs.groupBy(first.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
