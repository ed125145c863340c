"""Operator 12: phrases mined from a weighted de Bruijn graph.

Nodes are phrases one word shorter than the longest, edges are the longest phrases, which join nodes that overlap. Only
edges are counted over the texts; one that meets the end of its piece is filled up with ends. A node's count is the
flow out of it: the edges that start with it, those into an end included, which are the corrections for piece ends.
Shorter phrases follow from longer ones the same way. Nodes with one way in and one way out carry the flow of their
edges unchanged and are compacted into paths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2_000
UNKNOWN_LANG = "und"
#: UTF-8 bytes of text whose edges share a bucket; a task merges one bucket at a time.
BUCKET_BYTES = 16_000_000
#: Words, and distinct words, after which a task sends its edges on.
SEND_WORDS, SEND_DISTINCT = 2_000_000, 400_000
#: Bytes of a text that are split into words at once, edges that a merge holds before it adds up equal ones.
SLICE_BYTES, HELD_EDGES = 4_000_000, 2_000_000
#: Edges of a compacted path to a row; longer paths have several.
SECTION = 1_000

#: A-Z in lower case, separators of pieces as a full stop, a tab as a blank.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_END = b"."


class Numbers(dict):
    """Numbers of names in the order in which they come."""

    def __missing__(self, name: bytes) -> int:
        n = self[name] = len(self)
        return n


def combined(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns in ascending order and the sums of their counts."""
    if not len(counts):
        return cols, counts
    bits = [max(1, int(c.max()).bit_length()) for c in cols]
    if sum(bits) <= 63:
        key = cols[0].astype(np.int64)
        for c, b in zip(cols[1:], bits[1:]):
            key = key << b | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort(cols[::-1])
        change = np.ones(len(order), dtype=bool)
        change[1:] = False
        for c in cols:
            change[1:] |= c[order[1:]] != c[order[:-1]]
        first = np.flatnonzero(change)
    return [c[order[first]] for c in cols], np.add.reduceat(counts[order], first)


def prefixes(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct ascending rows without their last column: the flow out of each."""
    if not len(counts):
        return cols[:-1], counts
    change = np.ones(len(counts), dtype=bool)
    change[1:] = False
    for c in cols[:-1]:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(change)
    return [c[first] for c in cols[:-1]], np.add.reduceat(counts, first)


def _array(a: np.ndarray) -> bytes:
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(a) or int(a.max()) < 1 << 8 * s)
    return struct.pack("<BQ", size, len(a)) + a.astype(f"<u{size}").tobytes()


def _names(names: list[bytes]) -> bytes:
    return _array(np.array([len(x) for x in names], dtype=np.int64)) + b"".join(names)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def array(self) -> np.ndarray:
        size, n = struct.unpack_from("<BQ", self.data, self.at)
        out = np.frombuffer(self.data, f"<u{size}", n, self.at + 9)
        self.at += 9 + size * n
        return out.astype(np.int64)

    def names(self) -> list[bytes]:
        ends = np.cumsum(self.array()) + self.at
        out, begin = [], self.at
        for end in ends.tolist():
            out.append(self.data[begin:end])
            begin = end
        self.at = begin
        return out


class Edges:
    """Counted rows of a language and words as numbers (0: the end of the piece), and the names of the numbers."""

    def __init__(self) -> None:
        self.langs, self.words = Numbers(), Numbers({_END: 0})
        self.held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.n = self.distinct = 0

    def hold(self, cols: list[np.ndarray], counts: np.ndarray) -> None:
        self.held.append((cols, counts))
        self.n += len(counts)

    def all(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.held:
            return [], np.zeros(0, dtype=np.int64)
        cols, counts = combined([np.concatenate(c) for c in zip(*[h[0] for h in self.held])], np.concatenate([h[1] for h in self.held]))
        self.held, self.n, self.distinct = [(cols, counts)], len(counts), len(counts)
        return cols, counts

    def add(self, blob: bytes) -> None:
        """Adds the rows of a blob."""
        import zstandard

        r = Reader(zstandard.ZstdDecompressor().decompress(blob))
        langs = np.array([self.langs[x] for x in r.names()], dtype=np.int32)
        words = np.array([0, *[self.words[x] for x in r.names()]], dtype=np.int32)
        width = int(r.array()[0])
        cols = [langs[r.array()], *[words[r.array()] for _ in range(width - 1)]]
        self.hold(cols, r.array())
        if self.n >= HELD_EDGES + 2 * self.distinct:
            self.all()

    def blobs(self, cols: list[np.ndarray], counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
        """The rows by bucket, each with the names that it uses. A row's bucket depends on its names alone."""
        import xxhash
        import zstandard

        if not len(counts):
            return
        compress = zstandard.ZstdCompressor(level=3).compress
        langs, words = list(self.langs), list(self.words)
        hashes = [np.array([xxhash.xxh64_intdigest(x) for x in names], dtype=np.uint64) for names in (langs, words)]
        h = hashes[0][cols[0]]
        for c in cols[1:]:
            h = shared.mix64(h * np.uint64(0x9E3779B97F4A7C15) + hashes[1][c])
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        place, used = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            rows = order[ends[b] : ends[b + 1]]
            own = [c[rows] for c in cols]
            used[:] = False
            for c in own[1:]:
                used[c] = True
            used[0] = False
            mine = np.flatnonzero(used)
            place[mine] = np.arange(1, len(mine) + 1)
            body = [_names(langs), _names([words[i] for i in mine.tolist()]), _array(np.array([len(cols)])), _array(own[0]), *[_array(place[c]) for c in own[1:]], _array(counts[rows])]
            yield b, compress(b"".join(body))


class Texts(Edges):
    """The edges of texts as they are read."""

    def __init__(self, longest: int):
        super().__init__()
        self.longest = longest
        self.parts: list[np.ndarray] = []
        self.part_langs: list[int] = []
        self.size = 0

    @property
    def full(self) -> bool:
        return self.size >= SEND_WORDS or len(self.words) >= SEND_DISTINCT

    def append(self, lang: bytes, words: list[bytes]) -> None:
        number = self.words.__getitem__
        self.parts.append(np.fromiter(map(number, words), dtype=np.int32, count=len(words)))
        self.part_langs.append(self.langs[lang])
        self.size += len(words)

    def count(self, keep: int = 0) -> list[bytes]:
        """Counts the edges that start before the last keep words, which the last text goes on from; returns those words."""
        ids = np.concatenate([*self.parts, np.zeros(self.longest, dtype=np.int32)]) if self.parts else np.zeros(self.longest, dtype=np.int32)
        lang = np.repeat(np.array(self.part_langs, dtype=np.int32), [len(p) for p in self.parts])
        n = len(ids) - self.longest
        starts = np.flatnonzero(ids[: max(n - keep, 0)])
        cols, last = [lang[starts], ids[starts]], ids[starts]
        for j in range(1, self.longest):
            last = np.where(last != 0, ids[starts + j], 0)
            cols.append(last)
        self.hold(cols, np.ones(len(starts), dtype=np.int64))
        names = list(self.words)
        return [names[i] for i in ids[max(n - keep, 0) : n].tolist()]


def slices(data: bytes) -> Iterator[bytes]:
    """The translated bytes of a text in parts that don't cut words."""
    data = data.translate(_TABLE)
    at = 0
    while len(data) - at > SLICE_BYTES:
        blank, stop = data.find(b" ", at + SLICE_BYTES), data.find(_END, at + SLICE_BYTES)
        cut = min(x for x in (blank, stop, len(data)) if x >= 0)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _frame(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"lang": None, "phrase": None, "f": 0, "bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]})


ROWS = "lang string, phrase string, f long, bucket int, blob binary"


def edges_of_texts(docs: DataFrame, longest: int, buckets: int, text_col: str, lang_col: str) -> DataFrame:
    """The edges of the texts, added up within tasks, as rows bucket, blob."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = Texts(longest)
        for pdf in batches:
            for lang, data in zip(pdf["lang"], pdf["text"]):
                lang = lang.encode()
                for part in slices(data):
                    texts.append(lang, part.replace(_END, b" . ").split())
                    if texts.full:
                        rest = texts.count(longest - 1)
                        yield from map(_frame, sent(texts))
                        texts = Texts(longest)
                        texts.append(lang, rest)
                texts.append(lang, [_END])
        texts.count()
        yield from map(_frame, sent(texts))

    def sent(texts: Texts) -> Iterator[list[tuple[int, bytes]]]:
        cols, counts = texts.all()
        for row in texts.blobs(cols, counts, buckets):
            yield [row]

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), shared.text_of(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInPandas(read, ROWS).select("bucket", "blob")


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[dict[int, DataFrame], DataFrame]:
    """For each length up to longest the phrases that occur at least least times: lang, phrase, f; and lang, n: all words.

    Edges go to their bucket from each task added up, so a very frequent phrase is one row a task. A length's counts
    are the flows out of the phrases of the next, added up where these were merged before they are sent on.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))

    def merge(length: int):
        def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            edges = Edges()
            for pdf in batches:
                for blob in pdf["blob"]:
                    edges.add(blob)
            cols, counts = edges.all()
            if not len(counts):
                return
            langs, words = [x.decode() for x in edges.langs], [x.decode() for x in edges.words]
            often = np.flatnonzero((counts >= least) & (cols[-1] != 0))
            for i in range(0, len(often), 50_000):
                rows = often[i : i + 50_000]
                phrases = [" ".join([words[w] for w in ws]) for ws in zip(*[c[rows].tolist() for c in cols[1:]])]
                yield pd.DataFrame({"lang": [langs[x] for x in cols[0][rows].tolist()], "phrase": phrases, "f": counts[rows], "bucket": -1, "blob": None})
            cols, counts = prefixes(cols, counts)
            if length > 1:
                for row in edges.blobs(cols, counts, buckets):
                    yield _frame([row])
            else:
                yield pd.DataFrame({"lang": [langs[x] for x in cols[0].tolist()], "phrase": None, "f": counts, "bucket": -2, "blob": None})

        return merged

    blobs, found = edges_of_texts(docs, longest, buckets, text_col, lang_col), {}
    for length in range(longest, 0, -1):
        rows = shared.written(blobs.repartitionById(buckets, "bucket").mapInPandas(merge(length), ROWS), f"phrases-{length}", batch_rows=100 if length == longest else None)
        found[length] = rows.filter("bucket = -1").select("lang", "phrase", "f")
        blobs = rows.filter("bucket >= 0").select("bucket", "blob")
    return found, rows.filter("bucket = -2").groupBy("lang").agg(F.sum("f").alias("n"))


def first_words(phrase: Column, k: int | Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(k))


def last_words(phrase: Column, k: int) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(-k))


def compacted(found: dict[int, DataFrame], longest: int) -> DataFrame:
    """The edges as paths: lang, words, weight, in_flow, out_flow (counts of the first and the last node).

    A node is unary if one edge into it and one edge out of it have its whole count, so no piece starts or ends in it.
    Edges that meet at unary nodes are chained by pointer doubling, in as many rounds as the length of the longest path
    has bits; there are no circles, as pieces end. A row has at most SECTION edges.
    """
    node = found[longest - 1].withColumnRenamed("f", "flow")
    edges = found[longest].withColumns({"from": first_words(F.col("phrase"), longest - 1), "to": last_words(F.col("phrase"), longest - 1)})
    edges = edges.join(node.select("lang", F.col("phrase").alias("from"), F.col("flow").alias("in_flow")), ["lang", "from"])
    edges = shared.written(edges.join(node.select("lang", F.col("phrase").alias("to"), F.col("flow").alias("out_flow")), ["lang", "to"]), "phrase-edges")
    out = edges.filter("in_flow = f").select("lang", F.col("from").alias("node"), "phrase")
    into = edges.filter("out_flow = f").select("lang", F.col("to").alias("node"), F.col("phrase").alias("head"))
    links = shared.written(out.join(into, ["lang", "node"]).select("lang", "phrase", "head", F.lit(1).cast("long").alias("steps")), "phrase-links")
    while True:
        on = links.select("lang", F.col("phrase").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        moved = links.join(on, ["lang", "head"], "left").select("lang", "phrase", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        links = shared.written(moved, "phrase-links")
        if links.filter("moved").isEmpty():
            break
    links = links.drop("moved")
    placed = edges.join(links, ["lang", "phrase"], "left").withColumns({"head": F.coalesce("head", "phrase"), "steps": F.coalesce("steps", F.lit(0))})
    part = F.struct("steps", last_words(F.col("phrase"), 1).alias("word"), F.col("from").alias("node"), "in_flow", "out_flow")
    paths = placed.groupBy("lang", "head", F.floor(F.col("steps") / SECTION).alias("section"), F.col("f").alias("weight")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    words = F.concat(F.split(F.col("parts")[0]["node"], " "), F.col("parts.word"))
    return shared.written(paths.select("lang", words.alias("words"), "weight", F.col("parts")[0]["in_flow"].alias("in_flow"), F.element_at("parts", -1)["out_flow"].alias("out_flow")), "phrase-paths")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first phrases of 2 to longest words by score: lang, rank, phrase, a, l, r, n, score, cut.

    A text is lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and these into words at blanks and tabs.
    A phrase counts with all its occurrences in pieces, a, of at least least. Cut after its first words it has the counts
    l and r of its parts and the score floor(1000000 * a * a / (l * r)); the lowest counts, ties to the first cut. A
    phrase inside a longer one of at least least occurrences and of share % of its own isn't given. Ties of score go to
    the larger a, then the lesser phrase in bytes. Null languages are "und", null texts empty; repeated rows count each;
    an empty table gives no rows. Other columns are not read. 0 <= share <= 100; a * a * 1000000 must stay within 38
    digits, so a below 10 ** 15.
    """
    if longest < 2 or not 0 <= share <= 100:
        raise ValueError("longest must be at least 2 and share within 0 and 100")
    found, total = counted(docs, longest, least, text_col, lang_col)
    paths = compacted(found, longest)
    steps = F.sequence(F.lit(0), F.size("words") - longest)
    flow = lambda i: F.when(i == 0, F.col("in_flow")).when(i == F.size("words") - longest + 1, F.col("out_flow")).otherwise(F.col("weight"))
    phrase = lambda i, n: F.array_join(F.slice("words", i + 1, n), " ")
    edge = paths.select("*", F.explode(steps).alias("i"))
    long = edge.select("lang", phrase(F.col("i"), longest).alias("phrase"), F.col("weight").alias("a"), flow(F.col("i")).alias("first"), flow(F.col("i") + 1).alias("rest"))
    scored = [_scored(long, longest, found, known=True)]
    # What is inside a longer phrase is inside one that is a word longer and occurs at least as often as that.
    node = paths.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - longest + 1)).alias("i"))
    inside = node.select("lang", "weight", phrase(F.col("i"), longest - 1).alias("phrase"), flow(F.col("i")).alias("flow")).filter(F.col("weight") * 100 >= F.col("flow") * share)
    for length in range(longest - 1, 1, -1):
        mine = found[length].withColumnRenamed("f", "a").join(inside.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        scored.append(_scored(mine, length, found))
        if length > 2:
            parts = F.explode(F.array(first_words(F.col("phrase"), length - 1), last_words(F.col("phrase"), length - 1)))
            shorter = found[length - 1].select("lang", "phrase", F.col("f").alias("flow"))
            inside = found[length].select("lang", F.col("f").alias("weight"), parts.alias("phrase")).join(shorter, ["lang", "phrase"]).filter(F.col("weight") * 100 >= F.col("flow") * share)
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def _scored(phrases: DataFrame, length: int, found: dict[int, DataFrame], known: bool = False) -> DataFrame:
    """Phrases with their lowest cut. known: first and rest hold the counts without the last and without the first word."""
    cuts = []
    for k in range(1, length):
        left, right = (f"l{k}", first_words(F.col("phrase"), k), k, "first"), (f"r{k}", last_words(F.col("phrase"), length - k), length - k, "rest")
        for name, words, n, given in (left, right):
            if known and n == length - 1:
                phrases = phrases.withColumn(name, F.col(given))
            else:
                counts = found[n].select("lang", F.col("phrase").alias("_part"), F.col("f").alias(name))
                phrases = phrases.withColumn("_part", words).join(counts, ["lang", "_part"]).drop("_part")
        whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
        square = (F.lit(1_000_000).cast("decimal(7,0)") * whole("a", 15) * whole("a", 15)).cast("decimal(38,0)")
        score = F.call_function("div", square, (whole(left[0], 19) * whole(right[0], 19)).cast("decimal(38,0)"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).cast("long").alias("cut"), F.col(left[0]).alias("l"), F.col(right[0]).alias("r")))
    lowest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return phrases.withColumn("_cut", lowest).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score", "_cut.cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents")).drop("cut")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
one AS (SELECT lang, w[i] AS x, count(*) AS f FROM spots GROUP BY ALL),
two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL),
three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL),
often AS (SELECT * FROM three WHERE f >= 10),
inside AS (
  SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM often UNION ALL SELECT lang, y, z, f FROM often) GROUP BY ALL),
cut AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM often t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
  FROM often t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z
  UNION ALL
  SELECT b.lang, b.x || ' ' || b.y, b.f, 1, l.f, r.f
  FROM two b JOIN one l ON l.lang = b.lang AND l.x = b.x JOIN one r ON r.lang = b.lang AND r.x = b.y
  LEFT JOIN inside i ON i.lang = b.lang AND i.x = b.x AND i.y = b.y
  WHERE b.f >= 10 AND coalesce(100 * i.longer < 50 * b.f, true)),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
