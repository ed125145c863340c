"""Operator 13: vector codes by codebooks of parts, fitted over anchors hierarchies.

Vectors are cut into parts. The parts of a block of vectors lie in a metric tree, built once: anchors take over each
other's far points, then pairs of balls are merged upwards and each anchor is divided downwards the same way. A ball
keeps the sum and the count of its points. A round walks down the trees with the list of entries that may be nearest;
children take over their ball's list, and when one entry is left the ball's sums go to it without a look at its points.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts share a tree, and the points up to which a ball is not divided.
BLOCK, LEAF = 8_192, 48
#: Components up to this size keep squared distances and sums within 64 bits; larger ones are computed with whole numbers of any size.
NARROW = 1 << 26
#: Sums travel as sums of digits to this base.
DIGIT = 1 << 60
LONGEST = (1 << 63) - 1
#: Sums by label are broadcast up to so many labels; more are joined with a shuffle.
BROADCAST_LABELS = 100_000


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit numbers if all are small, else Python's."""
    y = np.floor(x * float(SCALE)) if np.abs(x).max(initial=0) <= NARROW / SCALE else None
    if y is not None:
        return y.astype(np.int64)
    # Multiplying by a power of two is exact; floats of this size are whole before it could overflow.
    return np.array([int(v) * SCALE if abs(v) >= 2**52 else math.floor(v * SCALE) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Tree:
    """An anchors hierarchy over points (rows of 64-bit numbers): arrays of balls, the root first, and the order of the points.

    A ball holds the points order[lo:hi]; left and right are -1 in a leaf. sums are those of its points.
    """

    FIELDS = ("order", "lo", "hi", "left", "right", "radius", "sums")

    def __init__(self, points: np.ndarray, **fields: np.ndarray):
        self.points = points
        self.__dict__.update(fields)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        floats = points.astype(np.float64)
        shape = cls._divide(floats, np.arange(len(points)), leaf)
        order, lo, hi, left, right = [], [], [], [], []
        at, todo = 0, [(shape, -1, False)]
        while todo:  # in preorder, so a ball's points follow each other
            node, parent, is_right = todo.pop()
            i = len(lo)
            if parent >= 0:
                (right if is_right else left)[parent] = i
            size = node[0]
            lo.append(at)
            hi.append(at + size)
            left.append(-1)
            right.append(-1)
            if len(node) == 2:
                order.append(node[1])
                at += size
            else:
                todo += [(node[2], i, True), (node[1], i, False)]
        order = np.concatenate(order)
        lo, hi = np.array(lo), np.array(hi)
        running = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points[order], axis=0)])
        sums = running[hi] - running[lo]
        centers, placed = sums / (hi - lo)[:, None], floats[order]
        radius = np.array([math.sqrt(((placed[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(lo.tolist(), hi.tolist(), centers)])
        return cls(points, order=order, lo=lo, hi=hi, left=np.array(left), right=np.array(right), radius=radius, sums=sums)

    @classmethod
    def _divide(cls, floats: np.ndarray, rows: np.ndarray, leaf: int):
        """(n, rows) of a leaf or (n, left, right)."""
        if len(rows) <= leaf:
            return (len(rows), rows)
        x = floats[rows]
        owner, pivots = anchors(x, math.ceil(math.sqrt(len(rows))))
        if len(pivots) == 1:
            return (len(rows), rows)
        by = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by], np.arange(len(pivots) + 1))
        members = [by[a:b] for a, b in zip(ends[:-1], ends[1:])]
        # Each anchor is divided further below, and merged with the others above.
        below = [cls._divide(floats, rows[m], leaf) for m in members]
        centers = np.array([x[m].mean(axis=0) for m in members])
        radius = np.array([math.sqrt(((x[m] - c) ** 2).sum(axis=1).max()) for m, c in zip(members, centers)])
        return merged(below, centers, radius, np.array([float(len(m)) for m in members]))

    def entries(self, codebook: np.ndarray) -> np.ndarray:
        """The nearest entry of each point in the order of the tree, ties to the lower index."""
        out = np.empty(len(self.points), dtype=np.int64)
        owned, open_points, nearest, _ = self.walk(codebook)
        for ball, e in zip(*owned):
            out[self.lo[ball] : self.hi[ball]] = e
        out[open_points] = nearest
        return out

    def totals(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points of each entry; a ball that one entry owns adds its own."""
        sums, counts = np.zeros(codebook.shape, dtype=np.int64), np.zeros(len(codebook), dtype=np.int64)
        (balls, e), open_points, nearest, _ = self.walk(codebook)
        np.add.at(sums, e, self.sums[balls])
        np.add.at(counts, e, self.hi[balls] - self.lo[balls])
        np.add.at(sums, nearest, self.points[self.order[open_points]])
        np.add.at(counts, nearest, 1)
        return sums, counts

    def walk(self, codebook: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, int]:
        """Balls that one entry owns and that entry; places in the order of the other points and their entries; the distances taken to balls.

        An entry leaves a ball's list if every point of the ball is nearer to the list's best by more than rounding.
        """
        books = codebook.astype(np.float64)
        between = np.sqrt(((books[:, None] - books[None]) ** 2).sum(axis=2))
        centers = self.sums / (self.hi - self.lo)[:, None]
        reach = max(np.abs(books).max(), np.abs(centers).max(), 1.0) + self.radius.max()
        slack = 1e-11 * books.shape[1] * (2 * reach) ** 2
        balls, lists = np.zeros(1, dtype=np.int64), np.ones((1, len(books)), dtype=bool)
        owned, leaves, measured = [], [], 0
        while len(balls):
            d = ((centers[balls][:, None] - books[None]) ** 2).sum(axis=2)
            measured += int(lists.sum())
            d[~lists] = np.inf
            best = d.argmin(axis=1)
            lists = lists & (d - d[np.arange(len(d)), best][:, None] <= 2 * (self.radius[balls] * (1 + 1e-9))[:, None] * between[best] + slack)
            sole = lists.sum(axis=1) == 1
            owned.append((balls[sole], best[sole]))
            is_leaf = ~sole & (self.left[balls] < 0)
            leaves.append((balls[is_leaf], lists[is_leaf]))
            inner = ~sole & ~is_leaf
            lists = np.repeat(lists[inner], 2, axis=0)
            balls = np.stack([self.left[balls[inner]], self.right[balls[inner]]], axis=1).ravel()
        balls, lists = np.concatenate([x[0] for x in leaves]), np.concatenate([x[1] for x in leaves])
        n = self.hi[balls] - self.lo[balls]
        places = np.repeat(self.lo[balls] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        d = distances(self.points[self.order[places]], codebook)
        d[~np.repeat(lists, n, axis=0)] = LONGEST
        return (np.concatenate([x[0] for x in owned]), np.concatenate([x[1] for x in owned])), places, d.argmin(axis=1), measured


def anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each point and the anchors' points. The point farthest from its anchor becomes the next one.

    A point can only be nearer to the new anchor if it lies beyond half the way between both anchors.
    """
    pivots = [0]
    away = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    owner = np.zeros(len(x), dtype=np.int64)
    while len(pivots) < k:
        new = int(away.argmax())
        if away[new] == 0:
            break
        half = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1)) / 2
        far = np.flatnonzero(away >= half[owner] * (1 - 1e-9))
        d = np.sqrt(((x[far] - x[new]) ** 2).sum(axis=1))
        won = d < away[far]
        away[far[won]], owner[far[won]] = d[won], len(pivots)
        pivots.append(new)
    return owner, np.array(pivots)


def merged(nodes: list, centers: np.ndarray, radius: np.ndarray, counts: np.ndarray):
    """The balls as one binary tree: the two whose common ball is smallest are merged, again and again."""
    nodes, centers, radius, counts = list(nodes), centers.copy(), radius.copy(), counts.copy()

    def common(i: int) -> np.ndarray:
        c = (centers * counts[:, None] + centers[i] * counts[i]) / (counts + counts[i])[:, None]
        return np.maximum(np.sqrt(((c - centers) ** 2).sum(axis=1)) + radius, np.sqrt(((c - centers[i]) ** 2).sum(axis=1)) + radius[i])

    size = np.array([common(i) for i in range(len(nodes))])
    np.fill_diagonal(size, np.inf)
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(size.argmin()), len(nodes))
        n = counts[i] + counts[j]
        r = size[i, j]
        centers[i] = (centers[i] * counts[i] + centers[j] * counts[j]) / n
        radius[i], counts[i] = r, n
        nodes[i], nodes[j] = (nodes[i][0] + nodes[j][0], nodes[i], nodes[j]), None
        gone = np.isinf(size[i]) & (np.arange(len(nodes)) != i)
        row = common(i)
        row[gone] = row[i] = row[j] = np.inf
        size[i], size[:, i] = row, row
        size[j], size[:, j] = np.inf, np.inf
    return next(n for n in nodes if n is not None)


def distances(points: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Exact squared distances of points and entries; both of 64-bit numbers within NARROW, or of Python's."""
    out = np.zeros((len(points), len(codebook)), dtype=points.dtype)
    for j in range(codebook.shape[1]):
        out += (points[:, j, None] - codebook[None, :, j]) ** 2
    return out


def narrow(x: np.ndarray) -> bool:
    return x.dtype != object and (not x.size or int(np.abs(x).max()) <= NARROW)


def nearest(tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each point and the squared distance, in the order of the points."""
    if narrow(tree.points) and narrow(codebook):
        entry = np.empty(len(tree.points), dtype=np.int64)
        entry[tree.order] = tree.entries(codebook)
        return entry, ((tree.points - codebook[entry]) ** 2).sum(axis=1)
    d = distances(tree.points.astype(object), codebook.astype(object))
    entry = np.array([min(range(len(codebook)), key=row.__getitem__) for row in d.tolist()], dtype=np.int64)
    return entry, d[np.arange(len(d)), entry]


def totals(tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if narrow(tree.points) and narrow(codebook):
        return tree.totals(codebook)
    entry, _ = nearest(tree, codebook)
    sums, points = np.full(codebook.shape, 0, dtype=object), tree.points.astype(object)
    for e, p in zip(entry.tolist(), points):
        sums[e] += p
    return sums, np.bincount(entry, minlength=len(codebook))


def _dump(a: np.ndarray) -> bytes:
    import io
    import json

    if a.dtype == object:
        return b"W" + json.dumps([list(a.shape), [str(v) for v in a.ravel()]]).encode()
    if a.dtype == np.int64:
        most = int(np.abs(a).max(initial=0))
        a = a.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return b"N" + out.getvalue()


def _load(data: bytes) -> np.ndarray:
    import io
    import json

    if data[:1] == b"W":
        shape, values = json.loads(data[1:])
        return np.array([int(v) for v in values], dtype=object).reshape(shape)
    a = np.load(io.BytesIO(data[1:]), allow_pickle=False)
    return a.astype(np.int64) if a.dtype.kind == "i" else a


def kept_vectors(rows: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v of the rows whose vector is whole and finite and has the commonest length among those whose length parts divides."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return kept.filter(F.size("v") == (length[0].n if length else 0))


BLOCKS = "vec_id array<string>, label array<string>, trees array<array<binary>>"


def build_trees(kept: DataFrame, parts: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of vectors that a task meets: their ids and labels, and a tree for each part, in shared files."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def made() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            x = whole(np.stack(rows["v"].to_numpy()))
            width = x.shape[1] // parts
            trees = []
            for p in range(parts):
                points = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                if narrow(points):
                    tree = Tree.build(points.astype(np.int64), leaf)
                    trees.append([_dump(points), *[_dump(getattr(tree, f)) for f in Tree.FIELDS]])
                else:
                    trees.append([_dump(points)])
            return pd.DataFrame({"vec_id": [_strings(rows["vec_id"])], "label": [_strings(rows["label"])], "trees": [trees]})

        for pdf in batches:
            while len(pdf):
                part, pdf = pdf.iloc[: block - n], pdf.iloc[block - n :]
                held.append(part)
                n += len(part)
                if n >= block:
                    yield made()
                    held, n = [], 0
        if n:
            yield made()

    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    plain = kept.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), "v")
    return shared.written(plain.mapInPandas(build, BLOCKS), "vector-trees")


def _strings(s: pd.Series) -> list[str | None]:
    return [None if pd.isna(x) else x for x in s]


def _trees(row) -> list[Tree]:
    return [Tree(_load(t[0]), **{f: _load(b) for f, b in zip(Tree.FIELDS, t[1:])}) for t in row]


def _digits(n: int) -> Iterator[tuple[int, int]]:
    """The digits of a number with its sign: place, digit."""
    sign, n, place = (-1 if n < 0 else 1), abs(n), 0
    while n:
        n, digit = divmod(n, DIGIT)
        if digit:
            yield place, sign * digit
        place += 1


def fit(blocks: DataFrame, codebooks: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds. Each task adds up its blocks; the driver sees one sum for each component of an entry."""
    for _ in range(rounds):

        def added(batches: Iterator[pd.DataFrame], books=codebooks) -> Iterator[pd.DataFrame]:
            sums = counts = None
            for pdf in batches:
                for row in pdf["trees"]:
                    found = [totals(tree, book) for tree, book in zip(_trees(row), books)]
                    if sums is None:
                        sums, counts = [s.astype(object) for s, _ in found], [c for _, c in found]
                    else:
                        sums, counts = [a + b[0] for a, b in zip(sums, found)], [a + b[1] for a, b in zip(counts, found)]
            if sums is None:
                return
            out = []
            for p, (s, c) in enumerate(zip(sums, counts)):
                for e in np.flatnonzero(c).tolist():
                    out.append((p, e, -1, 0, int(c[e])))
                    out += [(p, e, j, place, digit) for j, total in enumerate(s[e]) for place, digit in _digits(int(total))]
            yield pd.DataFrame(out, columns=["part", "entry", "at", "place", "n"])

        rows = blocks.select("trees").mapInPandas(added, "part int, entry int, at int, place int, n long").groupBy("part", "entry", "at", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        sums: dict[tuple[int, int], list[int]] = {}
        counts: dict[tuple[int, int], int] = {}
        for r in rows.collect():  # parts x entries x components, and digits of very large sums
            if r.at < 0:
                counts[r.part, r.entry] = int(r.n)
            else:
                total = sums.setdefault((r.part, r.entry), [0] * codebooks[r.part].shape[1])
                total[r.at] += int(r.n) * DIGIT**r.place
        codebooks = [b.astype(object) for b in codebooks]
        for (p, e), n in counts.items():
            codebooks[p][e] = [s // n for s in sums.get((p, e), [0] * codebooks[p].shape[1])]
        codebooks = [_slim(b) for b in codebooks]
    return codebooks


def _slim(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) <= NARROW for v in book.ravel()) else book


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in codebooks for v in b.ravel().tolist()).encode()).hexdigest()


def seeds(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids, null ids last and equal ids by their vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    x = whole(np.array([r.v for r in first], dtype=np.float64))
    width = x.shape[1] // parts
    return [_slim(x[:, p * width : (p + 1) * width].astype(object)) for p in range(parts)]


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped, and those whose length parts doesn't
    divide or isn't the commonest (ties: the longest) of the others. Repeated rows are coded each. With fewer rows than
    entries the codebooks have one entry a row. No rows: no rows. Components of any size are computed exactly; error and
    label_error stop at the largest 64-bit number. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    kept = kept_vectors(rows, parts, id_col, vector_col, label_col)
    blocks = build_trees(kept, parts, block, leaf)
    codebooks = fit(blocks, first, rounds) if (first := seeds(kept, parts, entries)) else []

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, labels, row in zip(pdf["vec_id"], pdf["label"], pdf["trees"]):
                found = [nearest(tree, book) for tree, book in zip(_trees(row), codebooks)]
                codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in found)
                yield pd.DataFrame({"vec_id": ids, "label": labels, "code": [c.tobytes().hex() for c in codes], "error": [min(e, LONGEST) for e in error]})

    ids, labels = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    codes = shared.written(blocks.mapInPandas(coded, "vec_id string, label string, code string, error long"), "vector-codes")
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = shared.written(by_label, "vector-labels").withColumnRenamed("label", "of")
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    met = codes.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")))
    own = F.col("vec_id").cast(ids) if not isinstance(ids, T.StringType) else F.col("vec_id")
    return met.select(own.alias("vec_id"), F.col("label").cast(labels).alias("label"), "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(shared.table(spark, sf_dir, "embeddings")).drop("label")


def _rounds_sql(rounds: int) -> str:
    out = []
    for i in range(1, rounds + 2):
        out.append(f"""
d{i} AS (SELECT x.vec_id, x.p, c.e, sum((x.y - c.y) * (x.y - c.y))::BIGINT AS d FROM x JOIN c{i - 1} c USING (p, j) GROUP BY ALL),
a{i} AS (SELECT vec_id, p, e, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if i <= rounds:
            out.append(f"""
s{i} AS (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id, p) GROUP BY ALL),
c{i} AS (SELECT p, e, j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c.y) AS y FROM c{i - 1} c LEFT JOIN s{i} USING (p, e, j))""")
    return ",".join(out)


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
flat AS (SELECT vec_id, len(v) // {PARTS} AS w, unnest(v) AS z, unnest(range(len(v))) AS i FROM kept),
x AS (SELECT vec_id, i // w AS p, i % w AS j, floor({SCALE} * z::DOUBLE)::BIGINT AS y FROM flat),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
c0 AS (SELECT p, e, j, y FROM x JOIN seed USING (vec_id)),{_rounds_sql(ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""
