"""Connected components, reachability rounds and exact fronts over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.operators import skyline, spatial
from transitlake.plans.storage import settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id) with root, the least id that edges(a, b) connect it with.

    Each round takes the least label among neighbours and then that label's own, so that long chains halve.
    """
    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    links = settled(links, "links")
    labels = settled(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        nearer = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = nearer.select(F.col("id").alias("via"), F.col("root").alias("end"))
        now = settled(nearer.join(jump, F.col("root") == F.col("via"), "left").select("id", F.least("root", F.coalesce("end", "root")).alias("root")), "labels")
        if now.join(labels, "id").filter(now["root"] != labels["root"]).isEmpty():
            return now
        labels = now


def near_components(nodes: DataFrame, radius_m: float) -> DataFrame:
    """nodes(id, lon, lat) with root, the least id that steps of up to radius_m connect them with.

    Nodes of one place are connected, so links are made between places only; nodes without one are connected with none.
    """
    places = settled(nodes.filter("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").groupBy("lon", "lat").agg(F.min("id").alias("a")), "places")
    edges = spatial.grid_join(places, places.select(F.col("a").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), radius_m).filter("a < b").select("a", "b")
    roots = components(places.select(F.col("a").alias("id")), edges).select(F.col("id").alias("a"), "root")
    of = places.join(roots, "a").select("lon", "lat", "root")
    return nodes.join(of, ["lon", "lat"], "left").select("id", F.coalesce("root", "id").alias("root")).distinct()


def reach_round(labels: DataFrame, patterns: DataFrame, limit_s: float) -> DataFrame:
    """One ride more: patterns(pattern, pos, node, cum_s, wait_s), labels(node, at_s).

    Along each pattern the best of at_s + wait_s - cum_s so far gives the arrival at each later stop; the least
    arrival of a node within limit_s is returned with the pattern that brings it.
    """
    boarded = patterns.join(labels, "node", "left").withColumn("start", F.col("at_s") + F.col("wait_s") - F.col("cum_s"))
    before = Window.partitionBy("pattern").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    arrived = boarded.withColumn("arrive_s", F.min("start").over(before) + F.col("cum_s")).filter(F.col("arrive_s") <= limit_s)
    return arrived.groupBy("node").agg(F.min(F.struct("arrive_s", "pattern")).alias("b")).select("node", F.col("b.arrive_s").alias("at_s"), "b.pattern")


def reach(start: DataFrame, patterns: DataFrame, transfers: DataFrame, rides: int, limit_s: float, places: DataFrame | None = None) -> DataFrame:
    """node, at_s, rides: the least arrival with up to so many rides, and the fewest that bring it.

    A walk of transfers(a, b, walk_s) may follow each ride but not another walk; labels are those at a round's start.
    With places(node, place) transfers are between places, each with itself in no time, and of those who ride to a
    place the first one walks on for all.
    """
    patterns = settled(patterns, "patterns")
    best = settled(start.groupBy("node").agg(F.min("at_s").alias("at_s")).withColumn("rides", F.lit(0)), "labels")
    marked = best.select("node", "at_s")
    for n in range(1, rides + 1):
        ridden = settled(reach_round(marked, patterns, limit_s), "ridden")
        there = ridden.select(F.col("node").alias("place"), "at_s") if places is None else ridden.join(places, "node").groupBy("place").agg(F.min("at_s").alias("at_s"))
        walked = there.join(transfers, F.col("place") == F.col("a")).select(F.col("b").alias("node"), (F.col("at_s") + F.col("walk_s")).alias("at_s")).filter(F.col("at_s") <= limit_s)
        if places is not None:
            walked = walked.groupBy(F.col("node").alias("place")).agg(F.min("at_s").alias("at_s")).join(places, "place").select("node", "at_s")
        new = ridden.select("node", "at_s").unionByName(walked).withColumn("rides", F.lit(n))
        best = settled(best.unionByName(new).groupBy("node").agg(F.min(F.struct("at_s", "rides")).alias("b")).select("node", "b.*"), "labels")
        marked = best.filter(F.col("rides") == n).select("node", "at_s")
        if marked.isEmpty():
            break
        marked = best.select("node", "at_s")
    return best


def exact_front(edges: DataFrame, source: str, target: str, max_taxi: int = 1) -> DataFrame:
    """The front of (time_s, fare) over all paths of edges(start, end, mode, time_s, fare) with up to max_taxi taxi rides.

    Labels of a round are extended by one edge, dominated ones of a node and number of taxis are dropped, and rounds
    end when none is new.
    """
    spark = edges.sparkSession
    held = settled(spark.createDataFrame([(source, 0, 0.0, 0.0)], "node string, taxis int, time_s double, fare double"), "held")
    open_ = held
    while not open_.isEmpty():
        step = open_.join(edges.withColumnsRenamed({"time_s": "dt", "fare": "df"}), F.col("node") == F.col("start"))
        taken = step.select(F.col("end").alias("node"), (F.col("taxis") + F.when(F.col("mode") == "taxi", 1).otherwise(0)).alias("taxis"), (F.col("time_s") + F.col("dt")).alias("time_s"), (F.col("fare") + F.col("df")).alias("fare")).filter(F.col("taxis") <= max_taxi)
        every = held.withColumn("new", F.lit(0)).unionByName(taken.withColumn("new", F.lit(1)))
        kept = settled(skyline.front(every, ["node", "taxis"], "time_s", "fare", "new"), "held")
        open_ = settled(kept.filter("new = 1").drop("new"), "open")
        held = kept.drop("new")
    return skyline.front(held.filter(F.col("node") == target), ["node"], "time_s", "fare", "taxis")
