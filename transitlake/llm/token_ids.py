"""Operator 11: token ids in binary files with a shared Zstandard dictionary.

The dictionary is trained on serialized id arrays. Each document is a frame of its own, so a short one is read alone:
a file holds the hash of its dictionary, the frames in ascending order of ids, and an index of their offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

MAGIC = b"TIDS0001"
#: The id that ends each document.
END_ID = 1
DICTIONARY_BYTES = 112_640
#: The dictionary is trained on the serialized ids of a piece of so many characters of each of so many documents, those
#: of least hash among all. Only the size of the files depends on it.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 4_096
#: UTF-8 bytes of text to a file, and the most files, so that the list of files stays small; beyond it files grow.
FILE_BYTES, MAX_FILES = 32_000_000, 50_000
#: Bytes of frames that a reader takes at once.
READ_BYTES = 8_000_000
#: Words whose ids a worker keeps at hand, and their length; the memo is emptied when full.
MEMO, MEMO_CHARS = 300_000, 32

#: What word_bpe_49k.json says of normalising and splitting; fixed values that the fast path relies on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split for lower-case text of Latin-1 and some punctuation, which normalising leaves as it is otherwise.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_BLANKS}]+")
_BEYOND = re.compile("[^\x00-\xff‐-‧€]")


def _byte_level() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenEncoder:
    """Serialized ids of texts, unsigned 32-bit little-endian, as the tokenizers library gives them without added special tokens.

    Where the file splits texts as word_bpe_49k.json does, the ids of each word are asked of the library's model once
    and kept; texts outside Latin-1 or with the strings of special tokens go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [])
        split = steps[0] if len(steps) == 2 else {}
        self.by_words = (
            spec["model"]["type"] == "BPE"
            and spec["normalizer"] == _NORMALIZER
            and split.get("type") == "Split"
            and split.get("pattern") == {"Regex": _SPLIT}
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and steps[1]["type"] == "ByteLevel"
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and not any(t["normalized"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.visible = _byte_level()
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.visible))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words or _BEYOND.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, word = self.memo.get, self.word
        return b"".join([known(w) or word(w) for w in _WORDS.findall(text.lower())])


    def head(self, text: str, n: int) -> str:
        """The beginning of a text that its first n tokens stand for."""
        ends = [end for _, end in self.tokenizer.encode(text, add_special_tokens=False).offsets]
        return text if n >= len(ends) else text[: ends[n - 1]] if n > 0 else ""


def encoder(path: str) -> TokenEncoder:
    return shared.held(("token ids", path), lambda: TokenEncoder(path))


def with_lengths(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows with n_tokens in place of their column text; every other column is handed on as it is."""
    path, names = tokenizer or default_tokenizer(), [c for c in rows.columns if c != "text"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            n = pa.array([len(encode(t.as_py() or "")) // 4 for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], n], [*names, "n_tokens"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(measured, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the serialized ids of a sample of text pieces; few or too even samples are taken as raw content."""
    import zstandard

    h = F.xxhash64("doc_id", "text")
    start = (F.pmod(h, F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1).cast("int")
    pieces = docs.filter("text <> ''").select(h.alias("h"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("h").limit(SAMPLE_DOCS)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        for pdf in batches:
            yield pd.DataFrame({"ids": [encode(t) + end for t in pdf["text"]]})

    samples = [bytes(r.ids) for r in pieces.mapInPandas(encoded, "ids binary").collect()]  # at most SAMPLE_DOCS
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:DICTIONARY_BYTES] or struct.pack("<I", end_id)).ljust(8, b"\0")


class IdFile:
    """A file of token ids: MAGIC, hash of the dictionary, frames, then the index: offsets, numbers of ids, document ids and which are null."""

    HEAD = 8 + 32
    TAIL = struct.Struct("<QQ8s")

    @staticmethod
    def write(out, digest: bytes, compress, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int, int]:
        """Writes the documents as they come; only the index is held. Returns documents, ids and bytes written."""
        out.write(MAGIC + digest)
        offsets, counts, ids, nulls, at = array("Q"), array("Q"), array("q"), bytearray(), IdFile.HEAD
        for doc_id, data in documents:
            frame = compress(data)
            out.write(frame)
            offsets.append(at)
            counts.append(len(data) // 4)
            ids.append(0 if doc_id is None else doc_id)
            nulls.append(doc_id is None)
            at += len(frame)
        offsets.append(at)
        index = b"".join(np.asarray(a, dtype=t).tobytes() for a, t in ((offsets, "<u8"), (counts, "<u8"), (ids, "<i8"))) + bytes(nulls)
        out.write(index + IdFile.TAIL.pack(len(counts), at, MAGIC))
        return len(counts), sum(counts), at + len(index) + IdFile.TAIL.size

    def __init__(self, f, dictionary: bytes):
        import zstandard

        self.f = f
        size = f.size()
        n, at, magic = self.TAIL.unpack(f.read_at(self.TAIL.size, size - self.TAIL.size))
        head = f.read_at(self.HEAD, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a whole file of token ids")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        index = f.read_at(size - self.TAIL.size - at, at)
        self.offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 8 * (n + 1)).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", n, 8 * (2 * n + 1))
        self.nulls = np.frombuffer(index, np.uint8, n, 8 * (3 * n + 1)).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def documents(self, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The number and serialized ids of the documents of these ascending numbers; neighbours are read together, up to READ_BYTES."""
        i = 0
        while i < len(which):
            j = i + 1
            while j < len(which) and which[j] == which[j - 1] + 1 and self.offsets[which[j] + 1] - self.offsets[which[i]] <= READ_BYTES:
                j += 1
            base = int(self.offsets[which[i]])
            data = memoryview(self.f.read_at(int(self.offsets[which[j - 1] + 1]) - base, base))
            for k in which[i:j]:
                ids = self.decompress(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
                if len(ids) != 4 * self.counts[k]:
                    raise ValueError("a document's ids are cut short")
                yield int(k), ids
            i = j


def write_token_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, and returns the list of files: path, n_docs, n_ids, file_bytes, dictionary, first_id, first_hash, last_id.

    Documents lie in ascending order of their ids, null ids first; equal ids in the order of a hash of their texts,
    so repeated rows stand beside each other. Null and empty texts have the end id alone. Rows are range-partitioned,
    so a file's ids follow those of the file before, and a task holds the index of its file and one batch of texts.
    File names hold the task attempt and the list names those of attempts that succeeded only.
    """
    import zstandard

    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), shared.text_of(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    dictionary = train_dictionary(rows, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    fs, base = shared.filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{digest.hex()}.dictionary") as out:
        out.write(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = shared.filesystem(folder)
        encode, end, task = encoder(path).encode, struct.pack("<I", end_id), TaskContext.get()
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_dict_id=False).compress
        first, last = [], [None]

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for pdf in batches:
                for doc_id, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"]):
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    first or first.extend([doc_id, h])
                    last[0] = doc_id
                    yield doc_id, encode(text) + end

        rows = documents()
        begin = next(rows, None)
        if begin is None:
            return
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out:
            n, ids, size = IdFile.write(out, digest, compress, (x for part in ([begin], rows) for x in part))
        yield pd.DataFrame({"path": [name], "n_docs": [n], "n_ids": [ids], "file_bytes": [size], "dictionary": [digest.hex()], "first_id": [_text(first[0])], "first_hash": [first[1]], "last_id": [_text(last[0])]})

    files = min(MAX_FILES, max(1, -(-size // FILE_BYTES)))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    ordered = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "h", "text")
    schema = "path string, n_docs long, n_ids long, file_bytes long, dictionary string, first_id string, first_hash long, last_id string"
    manifest = shared.written(ordered.mapInPandas(write, schema), "token-id-files", batch_rows=shared.BATCH_ROWS)
    return manifest.withColumns({c: F.col(c).cast("long") for c in ("first_id", "last_id")})


def _text(x: int | None) -> str | None:
    return None if x is None else str(x)


def _listed(manifest: DataFrame) -> list:
    """The files in the order of their documents, at most MAX_FILES, each with the number of ids before it."""
    rows = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_hash))
    before, out = 0, []
    for r in rows:
        out.append((r.path, before, r.dictionary, r.first_id, r.last_id))
        before += r.n_ids
    return out


def _opened(fs, base: str, path: str, dictionary: str) -> IdFile:
    with fs.open_input_stream(f"{base}/{dictionary}.dictionary") as f:
        known = f.read()
    return IdFile(fs.open_input_file(f"{base}/{path}"), known)


def read_token_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its serialized ids)."""
    spark, listed = manifest.sparkSession, _listed(manifest)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = shared.filesystem(folder)
        for pdf in batches:
            for path, before, dictionary in zip(pdf["path"], pdf["before"], pdf["dictionary"]):
                found = _opened(fs, base, path, dictionary)
                crc = np.fromiter((zlib.crc32(ids) for _, ids in found.documents(np.arange(len(found.ids)))), dtype=np.int64, count=len(found.ids))
                ids = pd.Series(found.ids, dtype="Int64").mask(found.nulls).astype("string")
                yield pd.DataFrame({"doc_id": ids, "start": found.starts + before, "n_tokens": found.counts, "ids_crc32": crc})

    files = spark.createDataFrame([f[:3] for f in listed], "path string, before long, dictionary string").repartition(max(1, len(listed)))
    out = files.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def fetch_token_ids(manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the wanted documents alone, read by the offset index: doc_id, ids. Repeated wanted ids count once; unknown and null ones give no row."""
    listed = [f for f in _listed(manifest) if f[4] is not None]
    known = np.iinfo(np.int64).min
    first, last = np.array([known if f[3] is None else f[3] for f in listed], dtype=np.int64), np.array([f[4] for f in listed], dtype=np.int64)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy(np.int64)
            lo, hi = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            n = np.maximum(hi - lo, 0)
            yield pd.DataFrame({"file": np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), "doc_id": np.repeat(ids, n)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = shared.filesystem(folder)
        for pdf in batches:
            for file, group in pdf.groupby("file"):
                found = _opened(fs, base, listed[file][0], listed[file][2])
                at = np.flatnonzero(~found.nulls)
                own = found.ids[at]
                wanted = np.unique(group["doc_id"].to_numpy(np.int64))
                hits = at[np.isin(own, wanted)]
                out = [(int(found.ids[k]), np.frombuffer(ids, "<u4").astype(np.int64)) for k, ids in found.documents(hits)]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "ids"])

    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    dealt = ids.mapInPandas(places, "file long, doc_id long").repartition("file").sortWithinPartitions("file", "doc_id")
    return dealt.mapInPandas(read, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_dir(spark, "token-ids")
    return read_token_ids(write_token_ids(shared.table(spark, sf_dir, "documents"), folder), folder)


SQL = None
