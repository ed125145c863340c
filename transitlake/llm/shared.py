"""Shared storage, row access and small numeric helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and all runs on one machine, as in tests, a local folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows of whole texts or sets that go to a Python worker at once, which bounds what it and the JVM hold for it.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of shared files that a task reads where it explodes and counts them: it holds many times as much.
SPLIT_BYTES = 4 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"
#: Spark drops a query's shuffle files as it ends; without it they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _bytes(said: str) -> int:
    """Bytes as Spark's settings say them: 4194304, 4194304b, 16m, 16mb."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", said.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def written(df: DataFrame, what: str, compression: str = "zstd", batch_rows: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """The rows of df, read back from the shared folder: lineage ends at files that outlive any executor.

    The shuffle files of the write go with its end, as nothing reads them again.
    batch_rows: the rows that Python workers get at once while df is computed, if fewer than the session's.
    split_bytes: the bytes of files that a task reads while df is computed, if fewer than the session's.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    before, cleanup, split = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP), spark.conf.get(_SPLIT)
    try:
        spark.conf.set(_CLEANUP, "true")
        if batch_rows is not None:
            spark.conf.set(_BATCH, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
        if split_bytes is not None:
            spark.conf.set(_SPLIT, str(min(split_bytes, _bytes(split))))
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_SPLIT, split)
        spark.conf.set(_BATCH, before)
        spark.conf.set(_CLEANUP, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system of a shared folder and the path in it; tasks use it to reach side files."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def carried(docs: DataFrame, **needed: Column) -> DataFrame:
    """The rows of docs whole in _row, where their columns can't clash with others, and the columns needed."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(name) for name, c in needed.items()])


def first_of(kept: DataFrame, by: list[str], every: str | None = None) -> DataFrame:
    """One row of each that agree on by, the least by a hash of its columns in _row; all of those that every marks."""
    plain = [f"_row.`{f.name}`" for f in kept.schema["_row"].dataType.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*plain)))
    return kept.withColumn("_number", number).filter(F.col("_number") == 1 if every is None else (F.col("_number") == 1) | F.col(every))


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it was counted to have at most so many rows; else as it is, so its join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_HELD: dict[tuple, object] = {}


def held(name: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task, one thing at a time: workers are shared by all operators, and their memory would add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, for mapInArrow or mapInPandas, in a worker that keeps nothing from task to task.

    Workers wait for their next task while other operators run, so what Arrow's allocator holds unused, and what another
    operator left at hand, would count beside these.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        _HELD.clear()
        pa.default_memory_pool().release_unused()
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def rows_of(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as literals; createDataFrame would have executors start Python workers of another kind for them, which stay."""
    fields = StructType.fromDDL(schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    told = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*told)))


U = np.uint64
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n and on."""
    size = 1 << max(12, int(n).bit_length())
    if not _POW or max(_POW) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * U(pow(b, len(p), 1 << 64))])
            both.append(p)
        _POW.clear()
        _POW[size] = (both[0], both[1])
    return next(iter(_POW.values()))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes derives a hash of any span of the bytes."""
    p, _ = powers(len(data) + 1)  # longer than needed where a longer text came before
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
