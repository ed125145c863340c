"""Operator 6: removal of repeated passages by a sparse suffix array.

Sorting every suffix of a corpus moves a hundred times its bytes. Here the suffixes are those at anchors: of each
100-byte window, the start of its 16-gram of least hash. Equal windows have equal anchors, so all windows with the
same anchor form a run, whose bytes are the anchor's suffix and what stands before it. Runs whose 16-gram occurs
once can repeat nothing and are dropped. The others are range-partitioned by their leading bytes at splitters that
Spark samples, and sorted in each range by a multikey quicksort; neighbours that are equal repeat each other, and
windows of runs that share an anchor but differ elsewhere are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

WINDOW = 100
GRAM = 16
#: Window starts that are worked on together; longer texts are cut, with overlap.
PIECE = 200_000
#: An anchor that occurs oftener, so that its runs would fill some 100 MB of a task, goes by way of single windows, which are combined before the shuffle.
HOT = 50_000
#: Bytes of runs that a range holds, and runs that are sorted together at least.
RANGE_BYTES, SORT_RUNS = 24_000_000, 20_000
#: Rows get ids whose upper part is the number of the chunk that holds them.
CHUNK_SHIFT = 33

U = np.uint64
C1, C2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
POSITION = U(0xFFFFF)
FIRST = -(1 << 63)


class Runs:
    """The runs of the texts of a batch. Positions are in the joined bytes; start is where each run's text begins there."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(lengths) - lengths
        found = []
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + lengths[last] <= PIECE):
                size += int(lengths[last])
                last += 1
            base = int(self.start[first])
            for at in range(0, max(1, size - WINDOW + 1), PIECE):
                found.append(self._piece(first, last, lengths, base, at, min(size, at + PIECE + WINDOW - 1)))
            first = last
        empty = np.zeros(0, dtype=np.int64)
        columns = list(zip(*found)) if found else [[empty]] * 4 + [[empty.astype(np.uint64)]]
        self.text, self.anchor, self.lo, self.hi, self.gram = (np.concatenate(c) for c in columns)

    def _piece(self, first: int, last: int, lengths: np.ndarray, base: int, start: int, end: int):
        """Runs of the windows of bytes start to end, counted from base, of texts first to last."""
        n, lo = end - start, base + start
        empty = np.zeros(0, dtype=np.int64)
        if n < WINDOW:
            return empty, empty, empty, empty, empty.astype(np.uint64)
        raw = np.frombuffer(self.bytes[lo : lo + n] + bytes(GRAM), dtype=np.uint8)
        words = np.ndarray((n + 8,), "<u8", raw.data, 0, (1,))
        h = shared.mix64(words[:n] * C1 + words[8:])
        v = (h & ~POSITION) | np.arange(n, dtype=np.uint64)
        width, least, s = WINDOW - GRAM + 1, v, 1
        while 2 * s <= width:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        if rest := width - s:
            least = np.minimum(least[:-rest], least[rest:])
        at = (least[: n - WINDOW + 1] & POSITION).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int8)
        for i in range(first, last):
            a, b = max(0, int(self.start[i]) - lo), int(self.start[i] + lengths[i]) - lo - WINDOW + 1
            if b > a:
                inside[a : min(b, n)] = 1
        # A window inside ends before its text does, so windows inside with one anchor are of one text.
        which = np.flatnonzero(inside[: len(at)])
        if not len(which):
            return empty, empty, empty, empty, empty.astype(np.uint64)
        anchor = at[which]
        text = np.searchsorted(self.start[first:last], which + lo, side="right") - 1 + first
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
        return text[new], anchor[new] + lo, which[new] + lo, which[np.append(new[1:], len(which)) - 1] + lo, h[anchor[new]]


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans of one key that overlap or touch."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    group = np.concatenate(([True], key[1:] != key[:-1]))
    # Ends grow with an offset for each key, so that one running maximum serves all keys.
    shift = np.cumsum(group) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate(([True], start[1:] + shift[1:] > reach[:-1])))
    return key[new], start[new], (reach - shift)[np.append(new[1:], len(key)) - 1]


def snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, place (the id, null ids first) and text in shared files. All rows of a chunk come from one task, and rid >> CHUNK_SHIFT is its number."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(FIRST)).alias("place"), shared.text_of(text_col).alias("text"))
    return shared.written(rows, "passages-texts")


def by_chunk(df: DataFrame, what: str) -> str:
    """Writes df with a folder for each chunk, where the tasks that work on the chunk find its rows."""
    path = shared.shared_dir(df.sparkSession, what)
    df.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    return path


class SideFiles:
    """The rows by_chunk wrote for a chunk, those of the latest chunk being kept."""

    def __init__(self, uri: str):
        self.fs, self.base = shared.filesystem(uri)
        self.chunk, self.rows = None, None

    def of(self, chunk: int, columns: list[str]) -> pd.DataFrame:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if chunk != self.chunk:
            found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/chunk={chunk}", allow_not_found=True))
            parts = []
            for f in found:
                if f.path.endswith(".parquet"):
                    with self.fs.open_input_file(f.path) as opened:
                        parts.append(pq.read_table(opened, columns=columns).to_pandas())
            self.rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in columns})
            self.chunk = chunk
        return self.rows


def chunks_of(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for chunk, part in pdf.groupby(pdf["rid"].to_numpy() >> CHUNK_SHIFT, sort=False):
        yield int(chunk), part.sort_values(["place", "rid"])


def anchors(texts: DataFrame) -> DataFrame:
    """gram, chunk, n: how often each anchor occurs in a chunk, counted before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                for chunk, part in chunks_of(pdf):
                    gram, n = np.unique(Runs([t.encode() for t in part["text"]]).gram, return_counts=True)
                    yield pd.DataFrame({"gram": signed(gram), "chunk": chunk, "n": n})

    return texts.select("rid", "place", "text").mapInPandas(count, "gram long, chunk int, n long")


RECORD = "kind int, gram long, lead long, before int, windows int, place long, rid long, lo int, end int, run binary, w1 long, w2 long"


def records(texts: DataFrame, active: str) -> DataFrame:
    """What the active runs of each batch send on, by kind.

    0: a run to be sorted, the first of its bytes in the batch. 1: a span known to repeat an earlier one of the batch.
    2: a window of a hot anchor, the first of its bytes in the batch.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = SideFiles(active)
        with np.errstate(over="ignore"):
            for pdf in batches:
                for chunk, part in chunks_of(pdf):
                    yield from _send(part, side.of(chunk, ["gram", "hot"]))

    return texts.select("rid", "place", "text").mapInPandas(send, RECORD)


def _frame(kind: int, **columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    names = [c.split()[0] for c in RECORD.split(", ")]
    blank = {c: np.zeros(n, dtype=np.int64) for c in names if c != "run"} | {"run": [b""] * n}
    return pd.DataFrame(blank | {"kind": np.full(n, kind)} | columns)[names]


def _send(part: pd.DataFrame, listed: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if not len(listed):
        return
    grams = listed["gram"].to_numpy()
    order = np.argsort(grams)
    grams, hot_gram = grams[order], listed["hot"].to_numpy().astype(bool)[order]
    runs = Runs([t.encode() for t in part["text"]])
    mine = signed(runs.gram)
    spot = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
    on = np.flatnonzero(grams[spot] == mine)
    if not len(on):
        return
    text, anchor, lo, hi, gram, hot = runs.text[on], runs.anchor[on], runs.lo[on], runs.hi[on], mine[on], hot_gram[spot[on]]
    data = np.frombuffer(runs.bytes, dtype=np.uint8)
    rid, place = part["rid"].to_numpy()[text], part["place"].to_numpy()[text]
    # Texts stand in the order of their places, so the first of equal runs or windows is the earliest.
    h = hashed(data, lo, hi + WINDOW)
    h = shared.mix64(h + (anchor - lo).astype(np.uint64) * C1 + gram.view(np.uint64) * C2)
    _, first = np.unique(h, return_index=True)
    leads = np.zeros(len(on), dtype=bool)
    leads[first] = True
    spans = [(rid[~leads], (lo - runs.start[text])[~leads], (hi + WINDOW - runs.start[text])[~leads])]
    if (windowed := np.flatnonzero(leads & hot)).size:
        n = (hi - lo + 1)[windowed]
        which = np.repeat(windowed, n)
        at = np.repeat(lo[windowed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w1, w2 = window_hashes(data, at, anchor[which] - at, gram[which])
        _, first = np.unique(w1, return_index=True)
        lead = np.zeros(len(at), dtype=bool)
        lead[first] = True
        local = at - runs.start[text[which]]
        spans.append((rid[which][~lead], local[~lead], local[~lead] + WINDOW))
        yield _frame(2, place=place[which][lead], rid=rid[which][lead], lo=local[lead], end=local[lead] + WINDOW, w1=signed(w1[lead]), w2=signed(w2[lead]))
    key, start, end = merged(*(np.concatenate(c) for c in zip(*spans)))
    if len(key):
        yield _frame(1, rid=key, lo=start, end=end)
    kept = np.flatnonzero(leads & ~hot)
    raw = runs.bytes
    for a in range(0, len(kept), 50_000):
        k = kept[a : a + 50_000]
        lead = [int.from_bytes(raw[x : x + 8], "big") for x in anchor[k].tolist()]
        yield _frame(
            0, gram=gram[k], lead=signed(np.array(lead, dtype=np.uint64) ^ U(1 << 63)), before=(anchor - lo)[k], windows=(hi - lo + 1)[k], place=place[k], rid=rid[k],
            lo=(lo - runs.start[text])[k], run=[raw[x : y + WINDOW] for x, y in zip(lo[k].tolist(), hi[k].tolist())],
        )


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short spans whose starts don't fall; so many bytes at a time that their prefix sums stay in the cache."""
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        b = int(np.searchsorted(start, start[a] + PIECE))
        base, top = int(start[a]), int(end[a:b].max())
        out[a:b] = shared.span_hashes(shared.prefix_hashes(data[base:top]), start[a:b] - base, end[a:b] - base)
        a = b
    return out


def window_hashes(data: np.ndarray, at: np.ndarray, before: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window's bytes and of where its anchor stands."""
    one, two = hashed(data, at, at + WINDOW), hashed(data ^ 0x5A, at, at + WINDOW)
    tag = before.astype(np.uint64) * C1 + gram.view(np.uint64) * C2
    return shared.mix64(one + tag), shared.mix64(two ^ tag)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of 8-byte characters, and the group of equal strings at each place of it.

    Multikey quicksort: strings are parted by one character, and only parts of several strings go on to the next.
    """
    n, k = words.shape
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    many = np.ones(n, dtype=bool)  # by place: its part has several strings
    for d in range(k):
        places = np.flatnonzero(many)
        if not len(places):
            break
        mine = order[places]
        by = np.lexsort((words[mine, d], group[places]))
        order[places] = mine[by]
        word = words[order[places], d]
        split = np.zeros(n, dtype=np.int64)
        split[places[1:]] = (word[1:] != word[:-1]) & (group[places[1:]] == group[places[:-1]])
        change = np.concatenate(([0], group[1:] != group[:-1])).astype(np.int64)
        group = np.cumsum(np.maximum(change, split))
        size = np.bincount(group)
        many = size[group] > 1
    return order, group


def repeated_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """rid, start, end of what sorted runs repeat of earlier ones. All runs of a gram are in pdf."""
    pdf = pdf.sort_values(["place", "rid", "lo"], ignore_index=True)
    run, before, windows = pdf["run"].tolist(), pdf["before"].to_numpy().astype(np.int64), pdf["windows"].to_numpy().astype(np.int64)
    gram, rid, lo = pdf["gram"].to_numpy(), pdf["rid"].to_numpy(), pdf["lo"].to_numpy().astype(np.int64)
    width = -(-(2 * WINDOW) // 8) * 8
    text = np.frombuffer(b"".join((r[b:] + r[:b]).ljust(width, b"\0") for r, b in zip(run, before.tolist())), dtype=">u8").reshape(len(run), -1).astype(np.uint64)
    # From the anchor to the end, then what stands before it; then where both begin, which tells apart padded strings.
    order, group = multikey_order(np.column_stack([text, before.astype(np.uint64), windows.astype(np.uint64)]))
    # Sorting is stable, so the first of a group is its earliest.
    fresh = np.concatenate(([True], group[1:] != group[:-1]))
    copies, lead = order[~fresh], np.sort(order[fresh])
    out = [(rid[copies], lo[copies], lo[copies] + windows[copies] + WINDOW - 1)]
    _, code, kinds = np.unique(gram[lead], return_inverse=True, return_counts=True)
    lead = lead[kinds[code] > 1]
    if len(lead):
        data = np.frombuffer(b"".join(run[i] for i in lead), dtype=np.uint8)
        n = windows[lead]
        base = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
        which = np.repeat(np.arange(len(lead)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tag = (before[lead][which] - j).astype(np.uint64) * C1 + gram[lead][which].view(np.uint64) * C2
        h = shared.mix64(hashed(data, base[which] + j, base[which] + j + WINDOW) + tag)
        by = np.argsort(h, kind="stable")
        head = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        earliest = np.empty(len(h), dtype=np.int64)
        earliest[by] = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
        again = np.flatnonzero(earliest != np.arange(len(h)))
        if len(again):
            # Stretches of windows that repeat a stretch of one earlier run are compared byte by byte at once.
            src = earliest[again]
            cut = np.concatenate(([True], (again[1:] != again[:-1] + 1) | (src[1:] != src[:-1] + 1) | (which[again][1:] != which[again][:-1]) | (which[src][1:] != which[src][:-1])))
            a = np.flatnonzero(cut)
            z = np.append(a[1:], len(again)) - 1
            x, y = base[which[again[a]]] + j[again[a]], base[which[src[a]]] + j[src[a]]
            size = z - a + WINDOW
            raw = data.tobytes()
            same = np.array([raw[p : p + s] == raw[q : q + s] for p, q, s in zip(x.tolist(), y.tolist(), size.tolist())], dtype=bool)
            who = lead[which[again[a]]][same]
            out.append((rid[who], lo[who] + j[again[a]][same], lo[who] + j[again[a]][same] + size[same]))
    key, start, end = merged(*(np.concatenate(c) for c in zip(*out)))
    return pd.DataFrame({"rid": key, "start": start, "end": end})


def sorted_repeats(rows: DataFrame) -> DataFrame:
    """Range-partitions runs by leading bytes and gram, and finds in each range what repeats.

    A gram is never parted, so no comparison goes across a boundary; one in the middle of what is sorted together is
    carried over to the next.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        with np.errstate(over="ignore"):
            for pdf in batches:
                held.append(pdf)
                n += len(pdf)
                if n >= SORT_RUNS:
                    every = pd.concat(held, ignore_index=True)
                    gram = every["gram"].to_numpy()
                    other = np.flatnonzero(gram != gram[-1])
                    cut = int(other[-1]) + 1 if len(other) else 0
                    if cut:
                        yield repeated_spans(every.iloc[:cut])
                    held = [every.iloc[cut:]]
                    n = len(every) - cut
            if n:
                yield repeated_spans(pd.concat(held, ignore_index=True))

    size = rows.agg(F.coalesce(F.sum(F.octet_length("run") + 64), F.lit(0)).alias("n")).first().n
    ranges = rows.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "lead", "gram").sortWithinPartitions("lead", "gram")
    return ranges.select("gram", "before", "windows", "place", "rid", "lo", "run").mapInPandas(find, "rid long, start long, end long")


def hot_repeats(rows: DataFrame) -> DataFrame:
    """Windows of hot anchors that are not the earliest of their bytes; equal ones are combined before the shuffle."""
    at = F.struct("place", "rid", "lo")
    first = rows.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, ["w1", "w2"]).filter(at > F.col("first")).select("rid", F.col("lo").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 100-byte string covers it that also starts earlier, in a smaller id or before in the same text;
    rows of one id are taken in a fixed order, and null ids first. A null text is empty and keeps nothing. Texts
    under 100 bytes stay whole. Empty tables give no rows. Other columns are not read.
    """
    texts = snapshot(docs, id_col, text_col)
    counted = anchors(texts).withColumn("total", F.sum("n").over(Window.partitionBy("gram"))).filter("total > 1")
    active = by_chunk(counted.select("chunk", "gram", (F.col("total") > hot).alias("hot")), "passages-active")
    path = shared.shared_dir(docs.sparkSession, "passages-runs")
    records(texts, active).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    sent = docs.sparkSession.read.schema(RECORD).parquet(path)
    known = sent.filter("kind = 1").select("rid", F.col("lo").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans = known.unionByName(sorted_repeats(sent.filter("kind = 0"))).unionByName(hot_repeats(sent.filter("kind = 2")))
    marks = by_chunk(spans.withColumn("chunk", F.shiftright("rid", CHUNK_SHIFT).cast("int")), "passages-spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        side = SideFiles(marks)
        for pdf in batches:
            for chunk, part in chunks_of(pdf):
                rows = side.of(chunk, ["rid", "start", "end"])
                rid, start, end = merged(*(rows[c].to_numpy() for c in ("rid", "start", "end")))
                left, right = np.searchsorted(rid, part["rid"].to_numpy(), "left"), np.searchsorted(rid, part["rid"].to_numpy(), "right")
                out = []
                for text, a, b in zip(part["text"], left.tolist(), right.tolist()):
                    raw, kept, at = text.encode(), [], 0
                    for s, e in zip(start[a:b].tolist(), end[a:b].tolist()):
                        kept.append(raw[at:s])
                        at = e
                    rest = b"".join([*kept, raw[at:]])
                    out.append((rest, len(raw), len(raw) - len(rest), b - a, hashlib.sha256(rest).hexdigest()))
                done = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                yield done.assign(doc_id=part["doc_id"].to_numpy())[["doc_id", *done.columns]]

    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    out = texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(cut, "doc_id string, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.table(spark, sf_dir, "documents")).drop("kept")


SQL = None
