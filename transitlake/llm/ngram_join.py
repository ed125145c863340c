"""Operator 3: n-gram Jaccard join by prefix trees.

Every document's set of word shingles is a sequence in one global order. Two sets over the threshold share several
of the first shingles of their sequences, whatever the order. In the order of hashes these few are counted over all
documents: a document that shares too few of its own with any other has no partner and is left. Of the others every
shingle is counted, and the order becomes that of falling rarity. Documents that share a shingle of their rare
prefixes meet under it: their sequences, turned to start at the frequent end so that they share long paths, are
stored in a tree that each is run against. Only links that this verifies join documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, shared

PERCENT = 80
WORDS = 5
#: Sets, and shingles in all, that a tree holds; a larger group is dealt out in blocks. Only a single set can be over.
BLOCK, BLOCK_SHINGLES = 1_000, 1_000_000
#: The rarest shared shingles of each set that the first round takes; the others take all keys, in these shares of the last, where they still part components.
FIRST = 2
SHARES = (2, 16)
#: Numbers that a tree's table of counts holds, over all its sets.
COUNTS = 1_000_000
#: Bits a row of the bitmap that marks sets which may have a partner, and the logarithm of the most it may have.
MARK_BITS, MOST_MARK_BITS = 64, 30
#: Bytes of text that are hashed together.
CHUNK = 250_000
#: A shingle's place in the order: bits of the logarithm of its count above those of its hash.
HASH_BITS = 58

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; texts with fewer words have one of all their words."""
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < CHUNK):
            raw.append((texts[at] or "").encode())
            size += len(raw[-1])
            at += 1
        data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        blank = _SPACE[data]
        start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        end = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        h = shared.span_hashes(shared.prefix_hashes(data), start, end)
        ends = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(start, ends)
        joined = h[: max(0, len(h) - words + 1)].copy()
        for i in range(1, words):
            joined = shared.mix64(joined * C1 + h[i : len(h) - words + 1 + i])
        first = 0
        for last in upto.tolist():
            if last - first >= words:
                yield np.unique(joined[first : last - words + 1])
            elif last > first:
                whole = h[first]
                for i in range(first + 1, last):
                    whole = shared.mix64(np.array([whole * C1 + h[i]], dtype=np.uint64))[0]
                yield shared.mix64(np.array([whole + C2 * U(last - first)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
            first = last


def overlap(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n shingles with any partner."""
    return -(-percent * n // 100)


def spare(n: int, percent: int = PERCENT) -> int:
    """How many shingles of their prefixes partners share at least, if the smaller has n."""
    return 1 + n * (100 - percent) // 200


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Partners of n shingles or more share spare(n) of so many first ones: what comes after these is under the overlap."""
    return n - overlap(n, percent) + spare(n, percent)


class PrefixTree:
    """Sorted sequences in lexical order; what neighbours have in common is a path of the tree."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, sizes: np.ndarray | None = None):
        """sizes: of the whole sets, if sets have only what others have as well."""
        self.percent, self.sets = percent, sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.rank = np.empty(len(sets), dtype=np.int64)
        self.rank[self.order] = np.arange(len(sets))
        self.common = np.zeros(len(sets), dtype=np.int64)  # with the sequence before
        for r in range(1, len(sets)):
            a, b = sets[self.order[r - 1]], sets[self.order[r]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[r] = differ[0] if len(differ) else n
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64) if sizes is None else sizes
        most = max(2, min(4 * int(self.sizes.max()), COUNTS // len(sets)))
        self.parts = U(most)
        self.counts = np.stack([self.counted(s) for s in sets])

    def counted(self, s: np.ndarray) -> np.ndarray:
        """How many shingles of a set lie in each of the parts that their hashes are dealt to."""
        return np.bincount((s % self.parts).astype(np.int64), minlength=int(self.parts)).astype(np.uint32)

    def linked(self, q: np.ndarray, wanted: np.ndarray, size: int | None = None) -> list[int]:
        """Those of wanted that reach the threshold with q, a set of size shingles.

        The overlap up to a depth is shared by all sequences below it; a subtree is left as soon as its overlap and
        what can still come, by the lengths that remain, stay under what the threshold asks for. Sequences whose
        whole size, or whose counts in parts of the order, already rule them out are not walked to.
        """
        p, found, size = self.percent, [], len(q) if size is None else size
        sizes = self.sizes[wanted]
        near = (100 * sizes >= p * size) & (100 * size >= p * sizes)
        wanted, sizes = wanted[near], sizes[near]
        if not len(wanted):
            return found
        most = np.minimum(self.counts[wanted], self.counted(q)).sum(axis=1, dtype=np.int64)
        wanted = wanted[100 * most >= p * (size + sizes - most)]
        if not len(wanted):
            return found
        longest = max(len(self.sets[i]) for i in wanted.tolist())
        need = -(-p * (size + int(self.sizes[wanted].min())) // (100 + p))
        overlap, before, cut = np.zeros(1, dtype=np.int64), None, None
        for r in np.sort(self.rank[wanted]).tolist():
            s = self.sets[self.order[r]]
            same = 0 if before is None else int(self.common[before + 1 : r + 1].min())
            if cut is not None and same >= cut:
                continue  # below a path that was left; overlap still belongs to before
            same = min(same, len(overlap) - 1)
            at = np.minimum(np.searchsorted(q, s[same:]), len(q) - 1)
            hit = q[at] == s[same:]
            overlap = np.concatenate((overlap[: same + 1], overlap[same] + np.cumsum(hit)))
            depth = np.arange(same + 1, len(s) + 1)
            ahead = len(q) - np.searchsorted(q, s[same:], side="right")
            short = np.flatnonzero(overlap[same + 1 :] + np.minimum(ahead, longest - depth) < need)
            cut = int(depth[short[0]]) if len(short) else None
            before = r
            if cut is None and 100 * overlap[-1] >= p * (size + self.sizes[self.order[r]] - overlap[-1]):
                found.append(self.order[r])
        return found


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, dtype=np.int64)])))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of both, by which a row is found again; rows that repeat both are alike."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), shared.text_of(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def file_sets(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, row, n shingles, two halves of the set's signature, and the first shingles of the set in the order of hashes."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch["text"].to_pylist(), words):
                    n.append(len(s))
                    one.append(shared.mix64(s ^ C1).sum(dtype=np.uint64) if len(s) else U(0))
                    two.append(shared.mix64(s ^ C2).sum(dtype=np.uint64) if len(s) else U(0))
                    keys.append(signed(s[: prefix_length(len(s), percent)]))
            # The ids are handed on as they are: through pandas a null among them would make them floating point numbers.
            columns = [batch["doc_id"], batch["row"], pa.array(n, pa.int64()), pa.array(signed(np.array(one, dtype=np.uint64))), pa.array(signed(np.array(two, dtype=np.uint64))), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "s1", "s2", "keys"])

    return shared.written(rows.mapInArrow(shared.lean(filed), "doc_id long, row long, n long, s1 long, s2 long, keys array<long>"), "ngram-sets", "lz4", shared.BATCH_ROWS)


def even(c: Column) -> Column:
    return c.bitwiseAND(F.lit(-2).cast("long"))


def marked(near: DataFrame):
    """A bitmap of the rows of near at the last bits of their hashes, broadcast, and the mask of these bits.

    Rows that it marks are read again where they lie, so no text is shuffled. It has MARK_BITS bits a row up to
    MOST_MARK_BITS, 128 MB; beyond that more other rows are marked by chance, whose sets leave when near is joined.
    """
    size = 1 << max(16, min(MOST_MARK_BITS, math.ceil(math.log2(max(1, near.count() * MARK_BITS)))))
    place = F.col("row").bitwiseAND(F.lit(size - 1))
    parts = near.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((size >> 15, 4096), dtype=np.uint8)
    for r in parts.collect():  # 4 KB each, of all no more than the bitmap
        out[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return near.sparkSession.sparkContext.broadcast(out.tobytes()), size - 1


def sequences(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """node, n, codes: the sets that may have a partner, and their shingles that others of these have, the rarest first.

    node is the first half of the signature.

    Partners share spare(...) of their first shingles in any order, so who shares fewer of them with other sets of a size
    that a partner can have is left; what only copies of one set have is shared with none. Texts of the others are read
    again in place. Shingles that one set alone has count in n and aren't kept.
    Counts are combined before they are shuffled, and grow with the corpus, so their join shuffles at every size; a
    shingle that very many share is a skewed join that Spark splits.
    """
    # Partners' sizes lie in one band or in two neighbours, so each set files its keys in the two pairs that hold its own
    # band, told apart by the last bit of its name. A key that one set alone files in a pair is that set's own there,
    # what it files besides is shared; nothing is joined back to the keys.
    width = max(1.0001 * math.log(100 / percent), 1e-6)
    pair = F.explode(F.array(F.col("band") - 1, F.col("band")))
    filed = sets.select("s1", F.floor(F.ln("n") / width).alias("band"), F.explode("keys").alias("key")).select("s1", "key", pair.alias("pair"))
    filed = filed.select(F.xxhash64("key", "pair").alias("key"), even(F.col("s1")).bitwiseOR(F.col("pair").bitwiseAND(F.lit(1))).alias("by"))
    alone = filed.groupBy("key").agg(F.min("by").alias("lo"), F.max("by").alias("hi")).filter("lo = hi")
    odd = F.col("lo").bitwiseAND(F.lit(1)) == 1
    own = alone.groupBy(even(F.col("lo")).alias("even")).agg(F.count_if(odd).alias("own1"), F.count_if(~odd).alias("own0"))
    classes = sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("row"), F.max(F.size("keys")).alias("filed"))
    least = F.ceil(F.col("n") * percent / F.lit(100))
    shared_keys = F.col("filed") - F.least(F.coalesce("own0", F.lit(0)), F.coalesce("own1", F.lit(0)))
    enough = shared_keys >= 1 + F.floor(least * (100 - percent) / F.lit(200))
    near = shared.written(classes.join(own, even(F.col("s1")) == F.col("even"), "left").filter(enough).select("row", F.col("s1").alias("node"), "n"), "ngram-near", split_bytes=shared.SPLIT_BYTES)
    bits, mask = marked(near)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            place = batch["row"].to_numpy() & mask
            batch = batch.take(pa.array(np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)))
            with np.errstate(over="ignore"):
                found = list(shingle_sets(batch["text"].to_pylist(), words))
                signs = signed(np.array([shared.mix64(s ^ C1).sum(dtype=np.uint64) for s in found], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), _lists([signed(s) for s in found])], ["node", "keys"])

    every = shared.written(rows.select("row", "text").mapInArrow(shared.lean(told), "node long, keys array<long>"), "ngram-whole", "lz4", shared.BATCH_ROWS)
    tokens = every.select("node", F.explode("keys").alias("key"))
    counts = shared.written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "ngram-counts", "lz4", split_bytes=shared.SPLIT_BYTES)
    level = F.least(F.floor(F.log2("c")), F.lit(31)).cast("long")
    code = F.shiftleft(level, HASH_BITS).bitwiseOR(F.shiftrightunsigned("key", 64 - HASH_BITS))
    coded = tokens.join(counts.hint("merge"), "key").select("node", code.alias("code")).groupBy("node").agg(F.sort_array(F.array_distinct(F.collect_list("code"))).alias("codes"))
    return shared.written(coded.join(near.select("node", "n"), "node").select("node", "n", "codes"), "ngram-sequences", "lz4", split_bytes=shared.SPLIT_BYTES)


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by some columns, one at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        at = pdf[by].to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        if held and (held[-1][by].iloc[-1].to_numpy() != at[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        edges = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            if a:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b].reset_index(drop=True))
    if held:
        yield pd.concat(held, ignore_index=True)


def _tree_links(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a group: each asked set is run against the members that aren't in its component yet."""
    sets = [np.sort(~np.asarray(c, dtype=np.int64).view(np.uint64)) for c in pdf["codes"]]
    node, comp = pdf["node"].to_numpy(), pd.factorize(pdf["comp"])[0]
    member = np.flatnonzero(pdf["member"].to_numpy())
    if not len(member):
        return []
    size = pdf["n"].to_numpy()
    tree, out = PrefixTree([sets[i] for i in member], percent, size[member]), []
    for i in np.flatnonzero(pdf["asked"].to_numpy()).tolist():
        wanted = np.flatnonzero(comp[member] != comp[i])
        for j in tree.linked(sets[i], wanted, int(size[i])) if len(wanted) else ():
            if comp[member[j]] != comp[i]:
                out.append((int(node[i]), int(node[member[j]])))
                comp[comp == comp[member[j]]] = comp[i]
    return out


def links(filed: DataFrame, sets: DataFrame, whole: bool, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: verified links between sets that meet under a key of filed(key, node, n, comp) and are of different components.

    A key all of whose sets are in one component is done, and of keys with the same sets one is taken. A group larger
    than a block is dealt out in blocks. With whole, those of it that aren't in the component of its hub, the least
    set, are run against all blocks, so no pair is left out; without, each block has its own sets and the hub.
    """
    members = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")]
    same = [F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sig"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("sig2")]
    met = filed.groupBy("key").agg(*members, *same, F.min(F.struct("node", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    alike = met.groupBy("m", "shingles", "sig", "sig2", "hub").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("shingles") / block_shingles)).cast("int")
    keys = shared.written(alike.select("key", "m", blocks.alias("blocks"), F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "ngram-keys")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = filed.join(keys, "key").withColumn("loose", F.col("comp") != F.col("hub_comp"))

    def place(b, c, member, asked) -> Column:
        return F.struct(b.alias("block"), c.alias("chunk"), member.alias("member"), asked.alias("asked"))

    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    every_block = F.sequence(zero, F.col("blocks") - 1)
    if whole:
        loose = rows.filter("blocks > 1").groupBy("key").agg(F.count_if("loose").alias("l"), F.first("m").alias("of"), F.first("blocks").alias("in"))
        chunks = shared.written(loose.select("key", F.ceil(F.col("l") / F.col("of") * F.col("in")).cast("int").alias("chunks")), "ngram-chunks")
        rows = rows.join(chunks, "key", "left")
        own = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: place(mine, c, yes, no))
        chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
        asks = F.when(F.col("loose"), F.transform(every_block, lambda b: place(b, chunk, no, yes))).otherwise(F.array().cast("array<struct<block:int,chunk:int,member:boolean,asked:boolean>>"))
        many = F.concat(own, asks)
        one = F.array(place(zero, zero, yes, F.col("loose")))
    else:
        many = F.when(F.col("node") == F.col("hub"), F.transform(every_block, lambda b: place(b, zero, yes, yes))).otherwise(F.array(place(mine, zero, yes, yes)))
        one = F.array(place(zero, zero, yes, yes))
    dealt = rows.select("key", "node", "n", "comp", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)).alias("at")).select("key", "node", "n", "comp", "at.*")
    by = ["key", "block", "chunk"]
    sent = dealt.join(sets.select("node", "codes"), "node").repartition(*by).sortWithinPartitions(*by)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, by):
            out += _tree_links(group, percent)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return shared.written(sent.mapInPandas(shared.lean(walk), "a long, b long"), "ngram-links", batch_rows=shared.BATCH_ROWS)


def linked_components(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, first: int = FIRST) -> DataFrame:
    """node, root over verified links, for every node that isn't its own root."""
    n = F.col("n")
    alone = n - F.size("codes")  # shingles of this set only come first in the order and meet none
    prefix = F.slice("codes", F.lit(1), F.greatest(n - F.ceil(n * percent / F.lit(100)) + 1 - alone, F.lit(0)).cast("int"))
    filed = shared.written(sets.select("node", "n", F.posexplode(prefix).alias("at", "key")), "ngram-filed", "lz4")
    found = links(filed.filter(F.col("at") < first).select("key", "node", "n", F.col("node").alias("comp")), sets, False, percent, block, block_shingles)
    # A key is worked on whole once; what the first shares of keys join, the later ones needn't be sent for.
    share = F.pmod(F.xxhash64("key"), F.lit(SHARES[-1]))
    comps = graph.components(found)
    for low, high in zip((0, *SHARES), SHARES):
        now = filed.filter((share >= low) & (share < high)).join(comps, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp"))
        found = links(now, sets, True, percent, block, block_shingles)
        if not found.isEmpty():
            comps = graph.components(comps.toDF("a", "b").unionByName(found))
    return comps


def _told(rows: DataFrame, percent: int, words: int, block: int, block_shingles: int) -> DataFrame:
    """doc_id, row, n_shingles and root, the component, for every row; root is null without words."""
    sets = file_sets(rows, percent, words)
    comps = linked_components(sequences(rows, sets, percent, words), percent, block, block_shingles)
    told = sets.join(comps, F.col("s1") == F.col("node"), "left")
    return told.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "s1")).alias("root"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked if 100 * shared >= percent * all distinct shingles of both; component_id is the least id
    that links reach. Texts that are null, empty or blank have no shingles and are linked with nothing. Equal sets
    are one class from the start, known by a 64-bit signature of the set, so rows without an id link others as well.
    Repeated rows are rows of one class. Empty tables give no rows. Null ids count as the largest and stay null where
    only such are linked. Other columns are not read.
    """
    told = _told(_rows(docs, id_col, text_col), percent, words, block, block_shingles)
    least = shared.written(told.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "ngram-least")
    return told.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row of each component, that of the least id, with all its columns; nulls count as the largest ids.

    Of rows that repeat this id, one stays. Rows without words are linked with nothing and all stay. Empty tables
    give no rows.
    """
    told = _told(_rows(docs, id_col, text_col), percent, words, BLOCK, BLOCK_SHINGLES)
    first = told.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias("stay"), F.lit(False).alias("every")).unionByName(told.filter("root is null").select(F.col("row").alias("stay"), F.lit(True).alias("every")).distinct())
    rows = shared.carried(docs, row=F.xxhash64(F.col(f"`{id_col}`").cast("long"), shared.text_of(text_col)))
    kept = rows.join(stay, F.col("row") == F.col("stay"))
    return shared.first_of(kept, ["row"], "every").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(shared.table(spark, sf_dir, "documents"), percent=90, words=3)


SQL = None
