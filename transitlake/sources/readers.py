"""Readers and writers of the raw formats: all columns arrive as text and are cast where they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def blank_filled(df: DataFrame) -> DataFrame:
    """Missing text as the empty string, as the cleaning rules expect."""
    return df.na.fill("")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header as text columns; a byte order mark is dropped, blanks are kept.

    encoding MS949 needs spark.sql.legacy.javaCharsets, which is set for the read.
    """
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("nullValue", "\0")
    df = reader.csv(path) if columns is None else reader.schema(text_schema(columns)).csv(path)
    return blank_filled(df)


def read_records(spark: SparkSession, path: str, columns: Sequence[str], record: str = "^", field: str = "|") -> DataFrame:
    """Records that a mark other than the end of a line parts, the first naming the fields; line ends within are dropped."""
    rows = spark.read.option("lineSep", record).text(path).select(F.regexp_replace("value", r"[\r\n]", "").alias("value"))
    parts = F.split("value", F.lit(f"\\{field}"))
    named = rows.filter(F.trim("value") != "").select(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return named.filter(F.col(f"`{columns[0]}`") != columns[0])


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """A row per feature: its properties as text and all its rings, outer ones and holes, of every polygon."""
    place = "struct<type: string, coordinates: variant>"
    schema = f"features array<struct<properties: map<string, string>, geometry: {place}>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    polygon = F.variant_get(c, "$", "array<array<array<double>>>")
    many = F.variant_get(c, "$", "array<array<array<array<double>>>>")
    every = F.when(F.col("f.geometry.type") == "Polygon", polygon).when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
    return one.select(*[F.col("f.properties")[p].alias(p) for p in properties], F.transform(every, ring).alias("rings"))


STOP_TIMES = ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type")


def read_stop_times(spark: SparkSession, path: str, trips: DataFrame | None = None) -> DataFrame:
    """A timetable's lines with route_id, the part of the trip's id before _Ord; trips(route_id) keeps those of some routes."""
    rows = spark.read.option("header", True).schema(text_schema(STOP_TIMES)).csv(path).withColumn("route_id", F.regexp_extract("trip_id", r"^(.*)_Ord\d+$", 1))
    return rows if trips is None else rows.join(trips.select("route_id").distinct(), "route_id", "left_semi")


def parse_pages(pages: DataFrame, row_schema: str, body: str = "body") -> DataFrame:
    """Rows of XML pages; a page without its totals, or with fewer rows than it names, fails the job."""
    schema = f"totalCount long, numOfRows long, pageNo long, items struct<item: array<struct<{row_schema}>>>"
    inner = F.regexp_extract(body, r"(?s)<body>(.*)</body>", 1)
    parsed = pages.withColumn("_p", F.from_xml(F.concat(F.lit("<body>"), inner, F.lit("</body>")), schema))
    want = F.greatest(F.lit(0).cast("long"), F.least(F.col("_p.numOfRows"), F.col("_p.totalCount") - (F.col("_p.pageNo") - 1) * F.col("_p.numOfRows")))
    have = F.coalesce(F.size("_p.items.item"), F.lit(0))
    bad = F.col("_p.totalCount").isNull() | (F.when(F.col("_p.items").isNull(), 0).otherwise(have) != want)
    sound = parsed.filter(F.when(bad, F.raise_error(F.lit("a page is incomplete")).cast("boolean")).otherwise(True))
    return sound.select(F.explode("_p.items.item").alias("r")).select("r.*")


def file_date(path: Column) -> Column:
    """The date in a file's name, yyyymmdd or yyyy-mm-dd."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4})-?(\d{2})-?(\d{2})", 0)
    return F.try_to_timestamp(F.regexp_replace(found, "-", ""), F.lit("yyyyMMdd")).cast("date")


def latest_version(files: DataFrame, path: str = "path", pattern: str = r"^(.*?)\d") -> DataFrame:
    """Of files(path) the last by name of each kind, the part of the name before its first digit."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.groupBy(F.regexp_extract(name, pattern, 1).alias("kind")).agg(F.max_by(path, name).alias(path))


def write_csv(df: DataFrame, path: str, coordinates: Sequence[str] = ("lon", "lat")) -> None:
    """CSV with a header and coordinates to seven places; Parquet is the form for further work."""
    shown = [F.format_string("%.7f", F.col(c)).alias(c) if c in coordinates else F.col(c) for c in df.columns]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def stage_report(steps: dict[str, DataFrame]) -> DataFrame:
    """stage, label, n: how many rows each step of a job has."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage"), F.lit(label).alias("label"), "n") for i, (label, df) in enumerate(steps.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
