"""Streams of arrivals: windows, sessions, repeats within a time to live, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.plans.storage import shared_folder


def as_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the rows of parquet files, with event times that watermarks accept."""
    still = spark.read.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream watches a folder
        stream = reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent().toString()))
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in still.schema if f.dataType.simpleString() == "timestamp_ntz"})


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its output rows, from files.

    In complete mode each batch replaces the result, so windows that no watermark has closed are in it as well.
    """
    spark = stream.sparkSession
    out, checkpoint = shared_folder(spark, what), shared_folder(spark, f"{what}-progress")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, time: str, keys: list[str], width: str, late: str, value: Column) -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, time: str, keys: list[str], width: str, step: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str | None) -> DataFrame:
    """Sessions of the keys. late: how far behind the newest a row may come; None, in complete mode, takes all rows.

    A replay takes none: files come in any order, and with a watermark sessions lose late rows in complete mode too.
    """
    return (stream.withWatermark(time, late) if late else stream).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def once_within(stream: DataFrame, time: str, keys: list[str], ttl: str) -> DataFrame:
    """The first report of each key; reports of it within the time to live are repeats."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def daily_quota(events: DataFrame, time: str, kind: str, limits: dict[str, int], default: int, offset_hours: int = 9) -> DataFrame:
    """day, kind, used, left, of the days of a zone so many hours ahead of UTC."""
    day = F.to_date(F.col(time) + F.expr(f"INTERVAL {offset_hours} HOURS"))
    limit = F.coalesce(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)], F.lit(default)) if limits else F.lit(default)
    return events.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("used"), F.first(limit).alias("quota")).select("day", "kind", "used", F.greatest(F.lit(0).cast("long"), F.col("quota") - F.col("used")).alias("left"))
