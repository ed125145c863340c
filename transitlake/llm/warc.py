"""Operator 10: WARC archives of individually compressed records with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The magic number of the skippable frame that holds a WARC file's dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32_768
#: Raw record bytes after which a task closes an archive; a task holds no more than one archive's records.
ROLL_BYTES = 16_000_000
#: The table has no capture times, so records carry this date.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw record bytes that a task reads back, in whole archives.
READ_BYTES = 64_000_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> str | None:
    return record.removeprefix("<urn:x-page:").removesuffix(">") or None


def record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head of the page without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary trained from all its records, then a frame per record.

    Records too few or too alike to train on give a dictionary of raw content from the first of them.
    """
    import zstandard

    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8)
    except zstandard.ZstdError:
        trained = zstandard.ZstdCompressionDict(b"".join(records[:8])[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    compressor = zstandard.ZstdCompressor(level=6, dict_data=trained, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(compressor.compress(r) for r in records)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of each record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    stream = io.BufferedReader(decompressor.stream_reader(memoryview(data)[8 + size :], read_across_frames=True), 1 << 16)
    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row under folder and returns the manifest: path, records, raw_bytes, file_bytes.

    Payloads of at least min_bytes that are equal (by SHA-256 and length) have one response, the row of the largest
    id; the others are revisits of it. Rows that share this id as well are all responses. A null payload is empty;
    a null id sorts lowest. File names hold the task attempt, and the manifest, kept in shared files, names only
    those of attempts that succeeded, so a lost executor leaves no wrong archive.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).withColumns({"sha": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload")})
    # Only payloads that repeat have an owner to look up. Few of them are broadcast, by their written size, and no payload is sent.
    repeats = rows.groupBy("sha", "n").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    placed = rows.join(shared.written(repeats, "warc-repeats").withColumn("repeats", F.lit(True)), ["sha", "n"], "left")
    revisit = F.col("repeats").isNotNull() & (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    slim = placed.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("owner").cast("string").alias("owner"), revisit.alias("revisit"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = shared.filesystem(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        waiting: list[bytes] = []
        size, number = 0, 0

        def flush() -> pd.DataFrame:
            path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            data = archive(waiting)
            with fs.open_output_stream(path) as out:
                out.write(data)
            return pd.DataFrame({"path": [path], "records": [len(waiting)], "raw_bytes": [size], "file_bytes": [len(data)]})

        for pdf in batches:
            ids, urls, owners = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("page_id", "url", "owner"))
            for page_id, url, payload, owner, repeat in zip(ids, urls, pdf["payload"], owners, pdf["revisit"]):
                made = record(page_id, url, payload.encode(), owner, bool(repeat))
                waiting.append(made)
                size += len(made)
                if size >= ROLL_BYTES:
                    yield flush()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield flush()

    return shared.written(slim.mapInPandas(write, "path string, records long, raw_bytes long, file_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is hashed anew and held against its header.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = shared.filesystem(folder)
        for pdf in batches:
            for path in pdf["path"]:
                with fs.open_input_stream(path) as f:
                    data = f.read()
                out = []
                for headers, block in read_archive(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
                    found, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != n or digest(payload) != found):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    out.append((page_of(headers["WARC-Record-ID"]), n, found, kind, page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    size = manifest.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()[0]
    files = manifest.select("path").repartition(max(1, -(-size // READ_BYTES)))  # a number given is kept, however small the rows are
    found = files.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_dir(spark, "warc")
    return read_archives(write_archives(shared.table(spark, sf_dir, "pages"), folder), folder)


SQL = None
