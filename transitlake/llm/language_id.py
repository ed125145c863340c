"""Operator 9: language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import shared

ORDER = 5
#: The models are fitted on a sample of the labelled rows of about so many characters for each language, and in all.
SAMPLE_CHARS, SAMPLE_CHARS_IN_ALL = 3_000_000, 24_000_000
#: Labels that get a model, those of most text; ties by name. Documents of rarer labels are given the likeliest of these.
MAX_LANGUAGES = 500
#: Probability of a character that no model has seen: one of 2**16.
UNSEEN = 2.0**-16
#: Words whose scores a task keeps at hand, and scores in all.
MEMO, MEMO_SCORES = 400_000, 4_000_000
UNKNOWN = "und"
#: A document is rejected whose cross-entropy is over this quantile of the calibration documents of its language by so much;
#: a few wrong labels among these so don't matter.
QUANTILE, SLACK = 0.98, 1.0
#: Allowance, in nats times the root of the length, for the spread of short texts.
SHORT = 6.0
WORDS = r"\p{L}[\p{L}\p{M}]*"


def words_of(text: str) -> list[str]:
    import regex

    if text.isascii():
        return re.findall("[a-z]+", text.lower())
    return regex.findall(WORDS, text.lower())


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def gram_hashes(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters up to each of ends."""
    h = np.full(len(ends), n, dtype=np.uint64)
    for i in range(n - 1, -1, -1):
        h = shared.mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[ends - i])
    return h


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each between blanks; the places that are predicted; how many each word has."""
    pad = " " * (ORDER - 1)
    joined = "".join([pad + w + " " for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    counts = lengths + 1
    ends = np.repeat(starts + ORDER - 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return codes, ends, counts


class KneserNey:
    """The models of all languages: for each order a sorted array of gram hashes with a column of probabilities for
    each language, and a sorted array of context hashes with the weights of the next lower order."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: for each language, how often each word occurs."""
        self.langs = sorted(counts)
        order_counts = []  # for each language, by order: gram -> count
        for lang in self.langs:
            top: Counter[str] = Counter()
            pad = " " * (ORDER - 1)
            for w, n in counts[lang].items():
                s = pad + w + " "
                for i in range(len(w) + 1):
                    top[s[i : i + ORDER]] += n
            by_order = {ORDER: top}
            for k in range(ORDER - 1, 0, -1):
                by_order[k] = Counter(g[1:] for g in by_order[k + 1])  # continuation counts
            order_counts.append(by_order)
        self.grams, self.contexts = {}, {}
        lower: dict[str, np.ndarray] = {}
        floor = np.full(len(self.langs), UNSEEN)
        for k in range(1, ORDER + 1):
            every = sorted(set().union(*(c[k] for c in order_counts)))
            contexts = sorted({g[:-1] for g in every})
            at = {g: i for i, g in enumerate(contexts)}
            weight = np.ones((len(contexts), len(self.langs)))
            p = np.zeros((len(every), len(self.langs)))
            place = {g: i for i, g in enumerate(every)}
            for j, c in enumerate(order_counts):
                ones, twos = sum(n == 1 for n in c[k].values()), sum(n == 2 for n in c[k].values())
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = defaultdict(int), defaultdict(int)
                for g, n in c[k].items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                for ctx, n in total.items():
                    weight[at[ctx], j] = d * kinds[ctx] / n
                for g, n in c[k].items():
                    p[place[g], j] = (n - d) / total[g[:-1]]
            for g, i in place.items():
                p[i] += weight[at[g[:-1]]] * (lower.get(g[1:], floor) if k > 1 else floor)
            lower = {g: p[i] for g, i in place.items()}
            self.grams[k] = self.sorted_by_hash(every, k, p)
            self.contexts[k] = self.sorted_by_hash(contexts, k - 1, weight)
        self.limits = np.full(len(self.langs), np.inf)
        self.scale = 1.0

    @staticmethod
    def sorted_by_hash(strings: list[str], n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        ends = np.arange(len(strings)) * n + n - 1
        h = gram_hashes(codes, ends, n) if n else np.zeros(len(strings), dtype=np.uint64)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return i, hashes[i] == wanted

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each word in each language, and how many characters it predicts."""
        codes, ends, counts = padded(words)
        # From the highest order down: a gram that is stored needs none below, as its value is interpolated already.
        p = np.full((len(ends), len(self.langs)), UNSEEN, dtype=np.float32)
        at, weight = np.arange(len(ends)), np.ones((len(ends), len(self.langs)), dtype=np.float32)
        for k in range(ORDER, 0, -1):
            grams, values = self.grams[k]
            i, hit = self.find(grams, gram_hashes(codes, ends[at], k))
            p[at[hit]] = weight[hit] * values[i[hit]]
            at, weight = at[~hit], weight[~hit]
            if not len(at):
                break
            contexts, weights = self.contexts[k]
            i, hit = self.find(contexts, gram_hashes(codes, ends[at] - 1, k - 1)) if k > 1 else (np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool))
            weight[hit] *= weights[i[hit]]
        p[at] = weight * np.float32(UNSEEN)
        return np.add.reduceat(np.log(p.astype(np.float64)), np.cumsum(counts) - counts, axis=0), counts

    def judge(self, cross: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of cross-entropies over n characters: the best language, its share after scaling, and if it is rejected."""
        best = cross.argmin(axis=1)
        low = cross[np.arange(len(best)), best]
        share = 1 / np.exp(-(cross - low[:, None]) * self.scale).sum(axis=1)
        return best, share, low - SHORT / np.sqrt(n) > self.limits[best]

    def calibrate(self, cross: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Sets the scale of the shares by log-loss and, for each language, the cross-entropy above which it is rejected."""
        own = cross[np.arange(len(truth)), truth]
        gaps = cross - own[:, None]
        self.scale = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=lambda s: np.log(np.exp(np.clip(-gaps * s, -500, 500)).sum(axis=1)).sum())
        over = own - SHORT / np.sqrt(n)
        for j in range(len(self.langs)):
            if (mine := over[truth == j]).size:
                self.limits[j] = np.quantile(mine, QUANTILE) + SLACK


class Scorer:
    """Cross-entropies of texts; the scores of words met before are at hand up to a bound."""

    def __init__(self, model: KneserNey):
        self.model, self.place = model, {}
        self.room = min(MEMO, MEMO_SCORES // len(model.langs))
        self.values = np.zeros((self.room, len(model.langs)))
        self.lengths = np.zeros(self.room, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            first = len(self.place)
            values, lengths = self.model.log_probabilities(some)
            self.values[first : first + len(some)], self.lengths[first : first + len(some)] = values, lengths
            self.place.update(zip(some, range(first, first + len(some))))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, bits of no letter giving n = 0: cross-entropy by language, characters."""
        cross, chars = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            counted, new, until = [], set(), at
            while until < len(texts) and (until == at or len(new) < 10_000):
                counted.append(Counter(words_of(texts[until])))
                new.update(filterfalse(self.place.__contains__, counted[-1]))
                until += 1
            if len(self.place) + len(new) > self.room:
                self.place.clear()
                new = set().union(*counted)
            if len(new) <= self.room:
                self.learn(sorted(new))
                for i, words in enumerate(counted, at):
                    if words:
                        which = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                        times = np.fromiter(words.values(), np.int64, len(words))
                        chars[i] = times @ self.lengths[which]
                        cross[i] = -(times @ self.values[which]) / chars[i]
            else:  # one text with more different words than the memo holds
                for i, words in enumerate(counted, at):
                    total, every = np.zeros(len(self.model.langs)), sorted(words)
                    for part in range(0, len(every), 20_000):
                        some = every[part : part + 20_000]
                        values, lengths = self.model.log_probabilities(some)
                        times = np.array([words[w] for w in some])
                        total, chars[i] = total - times @ values, chars[i] + times @ lengths
                    cross[i] = total / max(1, chars[i])
            at = until
        return cross, chars


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """text, lang and calibrate of a bounded sample of the labelled documents outside the held-out fold, chosen by a hash of the id."""
    labelled = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(MAX_LANGUAGES).collect()
    each = min(SAMPLE_CHARS, SAMPLE_CHARS_IN_ALL // max(1, len(sizes)))
    # The upper 53 bits of the hash choose, finely enough for any size of corpus; the others part fit from calibration.
    cuts = shared.rows_of(docs.sparkSession, [(r.lang, int(min(1.0, each / r.chars) * (1 << 53))) for r in sizes], "lang string, cut long")
    chosen = labelled.join(F.broadcast(cuts), "lang").filter(F.shiftrightunsigned("h", 11) < F.col("cut"))
    return chosen.select("lang", "text", (F.col("h").bitwiseAND(F.lit(2047)) % 10 == 0).alias("calibrate"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KneserNey | None:
    """The models, or None if no document is labelled. Words are counted on the executors; the sample bounds what comes back."""
    sample = shared.written(training_sample(docs, id_col, text_col, lang_col), "language-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"]):
                seen.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()], columns=["lang", "word", "n"])

    fitted = sample.filter("not calibrate") if sample.filter("not calibrate").select("lang").distinct().count() == sample.select("lang").distinct().count() else sample
    rows = fitted.select("lang", "text").mapInPandas(shared.lean(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in rows.toLocalIterator():
        counts[r.lang][r.word] = r.n
    if not counts:
        return None
    model = KneserNey(counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, at = Scorer(sent.value), {x: i for i, x in enumerate(sent.value.langs)}
        for pdf in batches:
            cross, n = scorer.cross_entropies(list(pdf["text"]))
            yield pd.DataFrame({"truth": [at[x] for x in pdf["lang"]], "n": n, "cross": list(cross)})[n > 0]

    held = sample.filter("calibrate").select("lang", "text").mapInPandas(shared.lean(measure), "truth int, n long, cross array<double>").toPandas()
    if len(held):
        model.calibrate(np.stack(held["cross"].to_numpy()), held["n"].to_numpy(), held["truth"].to_numpy())
    return model


def identify(docs: DataFrame, model: KneserNey | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score and rejected.

    A text that is null or has no letter is und with score 0 and is rejected, as is every text without a model. Texts
    are read whole; their language, source and id play no part. Repeated rows are judged each; nothing is shuffled.
    Columns of docs named lang_pred, score or rejected are replaced.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")])
    if model is None:
        return kept.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, names = kept.columns.index(text_col), [*kept.columns, "lang_pred", "score", "rejected"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(sent.value), np.array([*sent.value.langs, UNKNOWN], dtype=object)
        for batch in batches:
            cross, n = scorer.cross_entropies([t or "" for t in batch.column(at).to_pylist()])
            best, share, out = sent.value.judge(cross, np.maximum(n, 1))
            added = [pa.array(langs[np.where(n > 0, best, -1)], pa.string()), pa.array(np.where(n > 0, share, 0.0)), pa.array(out | (n == 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    # The same kind of worker as in training and other operators, so executors don't keep a second set of them.
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return kept.mapInArrow(shared.lean(judged), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


SQL = None
