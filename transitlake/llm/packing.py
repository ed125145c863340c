"""Operator 1: variable-capacity best-fit packing of documents into sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, token_ids

SIZES = (512, 1024, 2048, 4096, 8192)
#: Pieces that are packed together; a task holds the lengths of one block at a time.
BLOCK = 100_000
#: Tokens of pieces that a worker gives back at once.
SENT_TOKENS = 1_000_000
PIECE = ("piece", "first_token", "n_tokens", "bin", "bin_size", "bin_offset")


def cost(size: int) -> float:
    """What a sequence of a permitted length costs: a fixed part, its tokens, and a part for attention."""
    return 32 + size + size * size / 16_384


def openings(sizes: Sequence[int], price: Callable[[int], float]) -> list[tuple[int, ...]]:
    """The size opened for pieces of up to each size, for every range of sizes, each choice once, the largest first."""
    found = {}
    for hi in reversed(range(len(sizes))):
        for lo in reversed(range(hi + 1)):
            found[tuple(min(sizes[max(lo, k) : hi + 1], key=lambda s: (price(s) / s, -s)) if k <= hi else sizes[k] for k in range(len(sizes)))] = None
    return list(found)


def best_fit(lengths: Sequence[int], sizes: Sequence[int], price: Callable[[int], float] = cost) -> tuple[list[int], list[int]]:
    """Bins of pieces in falling order of length: each piece's bin, and each bin's size.

    A piece goes to the open bin that it leaves least room in. If none fits, the bin opened is that of the permitted
    size, of those that hold the piece, with the least cost a token. Small bins are cut down less, large ones are
    filled up better, and which is cheaper depends on all pieces; so this is done for every range of sizes opened
    that makes another choice. At the end each bin is cut down to the least size that holds its contents, and the
    packing of the least total cost is returned: the sizes are chosen jointly. Ties: the larger size, the range of
    the larger sizes.
    """
    sizes = sorted(sizes)
    best = None
    for opened in openings(sizes, price):
        open_by_room: dict[int, list[int]] = {}
        rooms: list[int] = []
        used: list[int] = []
        where = []
        for n in lengths:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                b = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[i]
            else:
                room = opened[bisect_left(sizes, n)]
                b = len(used)
                used.append(0)
            used[b] += n
            where.append(b)
            if left := room - n:
                if left not in open_by_room:
                    open_by_room[left] = []
                    insort(rooms, left)
                open_by_room[left].append(b)
        cut = [sizes[bisect_left(sizes, u)] for u in used]
        total = sum(map(price, cut))
        if best is None or total < best[0]:
            best = (total, where, cut)
    return best[1], best[2]


def pack(docs: DataFrame, tokens: Column, sizes: Sequence[int] = SIZES, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bin, bin_size, bin_offset.

    A document longer than the largest size is cut into pieces of that size and a rest. Documents with no tokens or a
    null count have no piece. Pieces are dealt out by their document, sorted, and packed a block at a time, so a task
    holds one block of lengths whatever the key; equal lengths are packed in order of id. Repeated rows are packed
    each. No documents: no rows. Only ids and lengths are shuffled. A block's last bins of each size aren't filled by
    the next block; README has what that costs.
    """
    largest = max(sizes)
    n = F.coalesce(tokens.cast("long"), F.lit(0))
    lengths = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), n.alias("n")).filter("n > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(largest).cast("long")))
    pieces = lengths.select("doc_id", "n", first.alias("first_token")).select("doc_id", "first_token", F.least(F.lit(largest), F.col("n") - F.col("first_token")).cast("int").alias("n_tokens"))
    dealt = pieces.repartition("doc_id", "first_token").sortWithinPartitions("doc_id", "first_token", "n_tokens")
    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        held, rows = [], 0

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            pdf = pdf.iloc[np.argsort(-pdf["n_tokens"].to_numpy(), kind="stable")].reset_index(drop=True)
            where, cut = best_fit(pdf["n_tokens"].tolist(), sizes)
            where = np.array(where)
            pdf["bin"] = [f"{part}-{number}-{b}" for b in where]
            pdf["bin_size"] = np.array(cut, dtype=np.int32)[where]
            pdf["bin_offset"] = pdf.groupby(where)["n_tokens"].cumsum() - pdf["n_tokens"]
            pdf["piece"] = (pdf["first_token"] // largest).astype(np.int32)
            return pdf[["doc_id", "piece", "first_token", "n_tokens", "bin", "bin_size", "bin_offset"]]

        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= block:
                yield flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield flush()

    out = dealt.mapInPandas(packed, "doc_id string, piece int, first_token long, n_tokens int, bin string, bin_size int, bin_offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_tokens(docs: DataFrame, tokenizer: str | None = None, sizes: Sequence[int] = SIZES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """pack's rows with tokens, the ids of each piece, as a file of the tokenizers library gives them without special tokens.

    A sequence is the tokens of its bin's pieces in the order of bin_offset. Null and empty texts have no piece; a text
    without blanks is cut at the largest size like any other. Texts are encoded once; their ids wait, compressed, in
    shared files, while only row numbers and lengths are packed, and meet their pieces, listed a document, in one join.
    """
    path, largest = tokenizer or token_ids.default_tokenizer(), max(sizes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress = token_ids.encoder(path).encode, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            n, ids = [], []
            for text in batch["text"]:
                data = encoder(text.as_py())
                n.append(len(data) // 4)
                ids.append(compress(data))
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["rid", "doc_id", "n", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            # A row of a long document has many pieces; what is put out at once is bounded by tokens.
            for at in range(len(batch)):
                ids = np.frombuffer(decompress(batch["ids"][at].as_py()), "<u4").astype(np.int32)
                own = batch["pieces"][at].values
                first, n = own.field("first_token").to_numpy(), own.field("n_tokens").to_numpy()
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                tokens = np.concatenate([ids[a : a + k] for a, k in zip(first.tolist(), n.tolist())])
                columns = [pa.repeat(batch["doc_id"][at], len(n)), *[own.field(c) for c in PIECE], pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))]
                held.append(pa.RecordBatch.from_arrays(columns, ["doc_id", *PIECE, "tokens"]))
                size += len(tokens)
                if size >= SENT_TOKENS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), shared.text_of(text_col).alias("text"))
    encoded = shared.written(rows.mapInArrow(encode, "rid long, doc_id long, n long, ids binary"), "packing-tokens", batch_rows=shared.BATCH_ROWS)
    pieces = pack(encoded.select("rid", "n"), F.col("n"), sizes, "rid", block).withColumnRenamed("doc_id", "rid")
    listed = pieces.groupBy("rid").agg(F.collect_list(F.struct(*PIECE)).alias("pieces"))
    met = listed.join(encoded.filter("n > 0").select("rid", "doc_id", "ids"), "rid").select("doc_id", "pieces", "ids")
    return met.mapInArrow(cut, "doc_id long, piece int, first_token long, n_tokens int, bin string, bin_size int, bin_offset long, tokens array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(shared.table(spark, sf_dir, "documents"))


SQL = None
