"""Live first waits: each boarding meets the next arrival that its walk allows, in one sort of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_waits(boardings: DataFrame, arrivals: DataFrame, stop: str = "stop", on: tuple[str, ...] = ("line",)) -> DataFrame:
    """The boardings(ride, stop, on, walk_s, headway_s) with wait_s and source.

    arrivals(stop, on, at_s, predicted): seconds from now until a vehicle comes, null if it isn't known, and whether the
    operator predicts it or it was counted from the stops ahead. The first arrival not before the walk ends is taken:
    realtime or realtime_stops. After the last one known, whole headways are added to it: realtime+headway; without a
    headway missed_all. Without a wait: no_arrivals if nothing is told of the stop, no_match if nothing of the line,
    no_prediction if no time of it is known. Null keys match nothing. Of arrivals at one time a prediction comes first.

    Both sides are sorted together by key and time, backwards, and a boarding carries on the arrival last seen; so no
    pair of a boarding and an arrival is formed, and a stop with very many of both costs their sort.
    """
    keys = [stop, *on]
    known = arrivals.filter("at_s is not null").select(*keys, F.col("at_s").cast("double").alias("_t"), F.when(F.coalesce("predicted", F.lit(False)), "realtime").otherwise("realtime_stops").alias("_how"))
    # Of one time, what is counted comes first, then what is predicted, then boardings, which so see an arrival at their walk's end.
    seen = known.select(*keys, "_t", F.struct(F.col("_t").alias("at"), F.col("_how").alias("how")).alias("_a"), (F.col("_how") == "realtime").cast("int").alias("_order"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in boardings.schema.fields if f.name not in keys])
    none = F.lit(None).cast(seen.schema["_a"].dataType)
    asked = boardings.select(*keys, F.col("walk_s").cast("double").alias("_t"), none.alias("_a"), F.lit(2).alias("_order"), *[c for c in boardings.columns if c not in keys])
    backwards = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_order").rowsBetween(Window.unboundedPreceding, 0)
    met = seen.unionByName(asked).withColumn("_next", F.last("_a", ignorenulls=True).over(backwards)).filter("_order = 2")
    per_line = arrivals.groupBy(*keys).agg(F.max("at_s").cast("double").alias("_last"), F.lit(True).alias("_line"))
    per_stop = arrivals.groupBy(stop).agg(F.lit(True).alias("_stop"))
    told = met.join(per_line, keys, "left").join(per_stop, stop, "left")
    walk, headway, last = F.col("walk_s"), F.col("headway_s"), F.col("_last")
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    caught = keyed & F.col("_next").isNotNull()
    later = last + F.ceil((walk - last) / F.nullif(headway, F.lit(0))) * headway
    source = (
        F.when(caught, F.col("_next.how"))
        .when(F.col("_stop").isNull(), "no_arrivals")
        .when(F.col("_line").isNull(), "no_match")
        .when(last.isNull(), "no_prediction")
        .when(F.coalesce(headway, F.lit(0)) > 0, "realtime+headway")
        .otherwise("missed_all")
    )
    out = told.withColumn("source", source)
    wait = F.when(F.col("source").isin("realtime", "realtime_stops"), F.col("_next.at") - walk).when(F.col("source") == "realtime+headway", later - walk)
    return out.select(*boardings.columns, wait.alias("wait_s"), "source")


def replaced_waits(steps: DataFrame, firsts: DataFrame, key: str = "route") -> DataFrame:
    """steps(key, pos, type, wait_s, time_s) with live waits of firsts(key, wait_s, source) on the first ride of each key, and total_s.

    static_wait_s keeps the wait that was there; where no live wait is known the old one stays. total_s is the sum of
    times and waits of the whole key, null if a ride's wait isn't known.
    """
    ride = F.col("type").isin("BUS", "SUBWAY")
    first = F.min(F.when(ride, F.col("pos"))).over(Window.partitionBy(key))
    met = steps.withColumn("_first", first).join(firsts.select(key, F.col("wait_s").alias("_live"), F.col("source").alias("wait_source")), key, "left")
    live = (F.col("pos") == F.col("_first")) & F.col("_live").isNotNull()
    out = met.withColumns({"static_wait_s": F.when(live, F.col("wait_s")), "wait_s": F.when(live, F.round("_live")).otherwise(F.col("wait_s")), "wait_source": F.when(F.col("pos") == F.col("_first"), F.col("wait_source"))})
    whole = Window.partitionBy(key)
    total = F.when(F.count_if(ride & F.col("wait_s").isNull()).over(whole) == 0, F.sum(F.coalesce("time_s", F.lit(0.0)) + F.when(ride, F.col("wait_s")).otherwise(0.0)).over(whole))
    return out.withColumn("total_s", total).drop("_first", "_live")
