"""Operators on ordered sequences: positions, gaps, running sums, spans, windows of stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from transitlake.plans.storage import settled


def positions(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """pos from 0 along each key."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def ranked(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """rank from 1 over all rows, or those alike in by: the place within a range of the order, after the rows of the ranges before it.

    order: what no two rows share, else ties are ranked as they come. count names a column for the number of rows that
    are ranked together. A task sorts one range; a row for each range and for each of by is broadcast, so these are few.
    """
    sort = [*by, *order]
    # A number that is given is kept to; else Spark puts ranges together by their size as compressed, and a task holds many times that.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    # The upper bits of _at tell the range, the others the place in it.
    ranges = dealt.groupBy(F.shiftright("_at", 33).alias("_range"), *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # A row for each range and key is left, so windows over them hold nothing of size.
    alike = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(alike.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranges.select("_range", F.col("_first"), before.alias("_before"), F.sum("_n").over(alike).alias("_all"), *[F.col(c).alias(f"_by_{c}") for c in by])
    same = F.shiftright("_at", 33) == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = dealt.join(F.broadcast(counts), same).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return placed.select(*df.columns, "rank", *([F.col("_all").alias(count)] if count else []))


def quantile(value: str, rank: str, n: str, share: float) -> Column:
    """An aggregate over ranked values: what lies at a share of the way from the first to the last, between two as far as it lies."""
    at, i = (F.col(n) - 1) * share, F.col(rank) - 1
    low, high = F.floor(at), F.ceil(at)
    weight = F.when(i == low, F.when(low == high, 1.0).otherwise(high - at)).when(i == high, at - low)
    return F.sum(F.when(weight.isNotNull(), F.col(value) * weight))


def occurrences(seq: DataFrame, key: str, item: str) -> DataFrame:
    """First and last position and number of visits of each item of a sequence."""
    return seq.groupBy(key, item).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("visits"))


def with_previous(seq: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy("pos")
    return seq.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def with_next(seq: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy("pos")
    return seq.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def running(seq: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The sum of value from the start of the sequence up to each position."""
    return seq.withColumn(name, F.sum(F.coalesce(value, F.lit(0.0))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def ordered_pairs(seq: DataFrame, key: str, item: str) -> DataFrame:
    """For each key and two items the least gap from one to the other further on.

    Visits of an item to the key are joined with later ones; all of a key are one route, whose length is bounded.
    """
    board = seq.select(key, F.col(item).alias("board"), F.col("pos").alias("board_pos"))
    alight = seq.select(key, F.col(item).alias("alight"), F.col("pos").alias("alight_pos"))
    return board.join(alight, key).filter("alight_pos > board_pos").groupBy(key, "board", "alight").agg(F.min(F.col("alight_pos") - F.col("board_pos")).alias("gap"))


def best_gap(pairs: DataFrame, want: int) -> DataFrame:
    """Of each pair of ends the routes whose gap comes nearest to want; all that tie stay."""
    error = F.abs(F.col("gap") - want)
    least = F.min("error").over(Window.partitionBy("board", "alight"))
    return pairs.withColumn("error", error).withColumn("_least", least).filter("error = _least").drop("_least")


def interior(kept: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Those of dropped(key, pos) that lie strictly between the ends of what is kept."""
    ends = kept.groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return dropped.join(ends, key).filter("pos > lo and pos < hi").drop("lo", "hi")


def interpolated(seq: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Nulls between known neighbours by the share of positions; beyond the ends they stay null."""
    back = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    known = F.col(columns[0]).isNotNull()
    out = seq.withColumns({"_p0": F.last(F.when(known, F.col("pos")), True).over(back), "_p1": F.first(F.when(known, F.col("pos")), True).over(ahead)})
    for c in columns:
        out = out.withColumns({f"_a{c}": F.last(c, True).over(back), f"_b{c}": F.first(c, True).over(ahead)})
    share = (F.col("pos") - F.col("_p0")) / F.nullif((F.col("_p1") - F.col("_p0")).cast("double"), F.lit(0.0))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_a{c}") + (F.col(f"_b{c}") - F.col(f"_a{c}")) * share))
    return out.drop("_p0", "_p1", *[f"_{x}{c}" for c in columns for x in "ab"])


def window_matches(seq: DataFrame, key: str, item: str, wanted: Sequence[str]) -> DataFrame:
    """Windows of a sequence whose ends are those of wanted, with how many of wanted stand at their place."""
    n = len(wanted)
    row = Window.partitionBy(key).orderBy("pos").rowsBetween(0, n - 1)
    hits = F.aggregate(F.zip_with("_w", F.array(*map(F.lit, wanted)), lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    seen = seq.withColumn("_w", F.collect_list(item).over(row)).filter(F.size("_w") == n)
    return seen.filter((F.element_at("_w", 1) == wanted[0]) & (F.element_at("_w", -1) == wanted[-1])).withColumn("hits", hits).select(key, "pos", "hits")


def latest_rows(df: DataFrame, key: str, order: Sequence[Column], alias: str, base: str) -> DataFrame:
    """The first row of each key in the given order, with the other rows' different values of alias, in that order, in aliases.

    base: the value of alias that the kept row has. A key's rows are its versions, which are few.
    """
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    every = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(alias).alias("_v")))).alias("_all"))
    values = F.array_distinct(F.transform("_all", lambda x: x["_v"]))
    return ranked.filter("_rn = 1").drop("_rn").join(every, key).withColumn("aliases", F.array_join(F.filter(values, lambda v: v != F.col(base)), "|")).drop("_all")


def joined_chains(chains: DataFrame) -> DataFrame:
    """Pairs of chains(chain_id, line, stops) of a line, joined at a shared end where they have nothing else in common.

    Chains of a line are few; each meets those that begin where it ends.
    """
    turned = chains.unionByName(chains.withColumn("stops", F.reverse("stops")))
    a = turned.select("line", F.col("chain_id").alias("a"), F.col("stops").alias("sa"), F.element_at("stops", -1).alias("at"))
    b = turned.select(F.col("line").alias("line_b"), F.col("chain_id").alias("b"), F.col("stops").alias("sb"), F.element_at("stops", 1).alias("at_b"))
    met = a.join(b, (F.col("line") == F.col("line_b")) & (F.col("at") == F.col("at_b")) & (F.col("a") < F.col("b")))
    only = F.size(F.array_intersect("sa", "sb")) == 1
    return met.filter(only).select("line", "a", "b", F.concat("sa", F.slice("sb", F.lit(2), F.size("sb"))).alias("stops"))


def upstream(seq: DataFrame, key: str, cum: str, most: int = 12) -> DataFrame:
    """For each position and each of up to most stops before it, the time from there: ahead, upstream_s."""
    later = seq.select(key, F.col("pos"), F.col(cum).alias("_c"))
    ahead = F.explode(F.sequence(F.lit(1), F.least(F.lit(most).cast("long"), F.greatest(F.col("pos"), F.lit(1))).cast("int")))
    wanted = later.filter("pos > 0").withColumn("ahead", ahead).withColumn("_p", F.col("pos") - F.col("ahead"))
    before = seq.select(key, F.col("pos").alias("_p"), F.col(cum).alias("_b"))
    return wanted.join(before, [key, "_p"]).select(key, "pos", "ahead", (F.col("_c") - F.col("_b")).alias("upstream_s"))


def toward(chains: DataFrame, rides: DataFrame) -> DataFrame:
    """The stop next after boarding on the way to alighting, of rides(ride_id, chain, board, alight).

    chains(chain, is_loop, stops). On a loop the shorter way round is taken, ties forward.
    """
    met = rides.join(chains, "chain").withColumns({"n": F.size("stops"), "i": F.array_position("stops", F.col("board")).cast("int") - 1, "j": F.array_position("stops", F.col("alight")).cast("int") - 1}).filter("i >= 0 and j >= 0 and i <> j")
    ahead = F.pmod(F.col("j") - F.col("i"), F.col("n"))
    step = F.when(F.col("is_loop"), F.when(ahead * 2 <= F.col("n"), 1).otherwise(-1)).otherwise(F.signum(F.col("j") - F.col("i")).cast("int"))
    return met.select("ride_id", F.get("stops", F.pmod(F.col("i") + step, F.col("n"))).alias("toward"))


def progress(paths: DataFrame, positions_: DataFrame, key: str) -> DataFrame:
    """Where a position lies along a path: metres from its start and left to its end.

    paths(key, seg, ax, ay, bx, by), positions_(key, x, y), in metres of one projection: the nearest segment, ties the first.
    """
    size = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    w = Window.partitionBy(key)
    run = w.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = paths.withColumn("size", size).withColumns({"start": F.coalesce(F.sum("size").over(run), F.lit(0.0)), "all": F.sum("size").over(w)})
    met = segs.join(positions_, key)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.nullif(F.pow("size", F.lit(2)), F.lit(0.0)), F.lit(0.0))))
    placed = met.withColumn("t", t).withColumn("off", F.sqrt(F.pow(F.col("x") - F.col("ax") - F.col("t") * (F.col("bx") - F.col("ax")), 2) + F.pow(F.col("y") - F.col("ay") - F.col("t") * (F.col("by") - F.col("ay")), 2)))
    best = placed.groupBy(key).agg(F.min(F.struct("off", "seg", (F.col("start") + F.col("t") * F.col("size")).alias("done"), "all")).alias("b"))
    return best.select(key, F.col("b.done").alias("done_m"), (F.col("b.all") - F.col("b.done")).alias("left_m"), F.col("b.off").alias("off_m"))
