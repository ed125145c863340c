"""Operator 5: mixing sources to target weights by hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, token_ids

#: Weights among siblings; nodes without one count 1.
WEIGHTS: dict[tuple[str, ...], float] = {}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
#: How often a leaf's documents may be taken.
MAX_EPOCHS = 4
#: The budget in tokens as a share of the corpus.
BUDGET_SHARE = 1.0
SEED = 20_240_607
#: Documents that share a bucket of a leaf's order; only the bucket at a leaf's boundary is sorted.
BUCKET_DOCS = 4_096


def domain_of(source: Column) -> Column:
    """Sources come in four domains by their number; those without one are the domain other."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("other"))


def shares(children: DataFrame) -> DataFrame:
    """children(parent, node, w, cap, amount) with share: the amount of the parent dealt over its children by weight.

    No child gets more than its cap. In each round those that would are filled and the rest is dealt anew among the
    others, for all parents at once, until none is filled; so what one falls short of goes to its siblings by weight.
    """
    state = children.withColumn("full", F.lit(False))
    while True:
        sums = state.groupBy("parent").agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("gone"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("open"))
        rate = F.when(F.col("open") > 0, F.greatest(F.col("amount") - F.col("gone"), F.lit(0.0)) / F.col("open"))
        met = state.join(sums, "parent").withColumn("rate", rate)
        filled = ~F.col("full") & F.coalesce(F.col("rate") * F.col("w") >= F.col("cap"), F.lit(False))
        state = shared.written(met.withColumn("filled", filled), "mixing-shares")
        if state.filter("filled").isEmpty():
            break
        state = state.withColumn("full", F.col("full") | F.col("filled")).drop("gone", "open", "rate", "filled")
    return state.select("node", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.col("rate") * F.col("w"), F.lit(0.0))).alias("amount"))


def budgets(leaves: DataFrame, levels: int, weight: Callable[[tuple[str, ...]], float], budget: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaf, quota: the tokens that each leaf gives. leaves: level0, level1 and so on, and tokens; leaf is its path as JSON.

    A node's budget is split over its children by weight(path). A child never gets more than max_epochs times what lies
    below it; only what all children of a node can't take goes back to the node's own siblings, as the node's capacity
    is their sum. The tree is gone down a level at a time, all nodes of a level at once; nothing is collected.
    """
    names = [f"level{i}" for i in range(levels)]
    path = lambda n: F.to_json(F.array(*names[:n]) if n else F.array().cast("array<string>"))

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(w=[float(weight(tuple(p))) for p in pdf["path"]]).drop(columns="path")

    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    amounts = shared.rows_of(leaves.sparkSession, [("[]", min(float(budget), float(total) * max_epochs))], "parent string, amount double")
    for n in range(1, levels + 1):
        nodes = leaves.groupBy(*names[:n]).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap"))
        nodes = nodes.select(path(n - 1).alias("parent"), path(n).alias("node"), "cap", F.array(*names[:n]).alias("path"))
        nodes = nodes.mapInPandas(weighed, "parent string, node string, cap double, w double")
        amounts = shares(nodes.join(amounts, "parent")).withColumnRenamed("node", "parent")
    return amounts.select(F.col("parent").alias("leaf"), F.floor(F.col("amount") + 1e-6).alias("quota"))


def _place(docs: DataFrame, levels: Mapping[str, Column], id_col: str, text_col: str) -> DataFrame:
    """Each row in _row, with its doc_id, text, a hash of both by which it is found again, its levels and its leaf."""
    named = {f"level{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(levels.values())}
    out = shared.carried(docs, doc_id=F.col(f"`{id_col}`"), text=shared.text_of(text_col), **named)
    return out.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("leaf", F.to_json(F.array(*named)))


def _order(epoch: Column) -> Column:
    """A document's place in the order of an epoch: a hash of seed, epoch and id."""
    return F.xxhash64(F.lit(SEED), epoch, F.col("doc_id"))


def _bucket(h: Column, bits: Column) -> Column:
    shifted = F.shiftrightunsigned(h, 1)
    return F.call_function("shiftrightunsigned", shifted, (F.lit(63) - bits).cast("int"))


def plan(docs: DataFrame, levels: Mapping[str, Column], weight, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = BUCKET_DOCS, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """measured, leaves, edge.

    measured: doc_id, row, n_tokens and leaf of every document with tokens. leaves: for each leaf the full epochs, what
    is left for the next, the bits of its buckets, and the bucket at the boundary. edge: the documents of those buckets
    that the budget reaches, and how many of its first tokens each gives: all, but for the last.
    """
    placed = _place(docs, levels, id_col, text_col)
    level = [f"level{i}" for i in range(len(levels))]
    lengths = token_ids.with_lengths(placed.select("doc_id", "row", *level, "leaf", "text"), tokenizer)
    measured = shared.written(lengths, "mixing-measured", batch_rows=shared.BATCH_ROWS).filter("n_tokens > 0")
    stats = shared.written(measured.groupBy("leaf", *level).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-leaves")
    total = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = budgets(stats.select(*level, "tokens"), len(level), weight, budget_share * total, max_epochs)
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.col("docs") / bucket_docs, F.lit(1.0)))), F.lit(0)).cast("int")
    quota, tokens = F.col("quota"), F.col("tokens")
    quotas = stats.join(given, "leaf").select("leaf", F.floor(quota / tokens).alias("full"), (quota % tokens).alias("rest"), bits.alias("bits"))
    quotas = shared.written(quotas, "mixing-quotas")
    part = measured.join(shared.few(quotas), "leaf").filter("rest > 0").withColumn("h", _order(F.col("full")))
    part = part.withColumn("bucket", _bucket(F.col("h"), F.col("bits")))
    sums = part.groupBy("leaf", "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("bucket")))
    bounds = shared.written(
        running.filter("upto > rest").groupBy("leaf").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b")).select("leaf", "b.*"), "mixing-bounds"
    )
    leaves = quotas.join(bounds, "leaf", "left")
    last = part.join(shared.few(bounds), ["leaf", "bucket"])
    inside = Window.partitionBy("leaf").orderBy("h", "doc_id", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    edge = last.withColumn("at", before).filter("at < rest").select("leaf", "doc_id", "row", "n_tokens", F.least("n_tokens", F.col("rest") - F.col("at")).alias("taken"))
    return measured, shared.written(leaves, "mixing-plan"), shared.written(edge, "mixing-edge")


def _taken(placed: DataFrame, leaves: DataFrame) -> DataFrame:
    """placed with epochs, how many take a document whole, and edge, if the bucket at the boundary holds it."""
    met = placed.join(shared.few(leaves), "leaf").withColumn("h", _order(F.col("full")))
    at = _bucket(F.col("h"), F.col("bits"))
    before = (F.col("rest") > 0) & (F.col("bucket").isNull() | (at < F.col("bucket")))
    return met.withColumns({"epochs": F.col("full") + F.when(before, 1).otherwise(0), "edge": F.coalesce((F.col("rest") > 0) & (at == F.col("bucket")), F.lit(False))})


def mix(docs: DataFrame, levels: Mapping[str, Column], weight, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = BUCKET_DOCS, tokenizer: str | None = None) -> DataFrame:
    """One row per document and epoch that takes it: doc_id, the levels, n_tokens, epoch, taken.

    Tokens are those of a file of the tokenizers library. A leaf's budget is met to the token by whole epochs and then
    the prefix of the next epoch's tokens, documents coming in the order of a hash of seed, epoch and id; the document
    at its end gives its first tokens only, taken of n_tokens. Null levels count as the empty string; documents without
    tokens are never taken; repeated rows are taken each, in a fixed order. Empty tables give no rows.
    """
    measured, leaves, edge = plan(docs, levels, weight, budget_share, max_epochs, id_col, text_col, bucket_docs, tokenizer)
    whole = _taken(measured, leaves).filter("epochs > 0").withColumns({"epoch": F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)), "taken": F.col("n_tokens")})
    part = edge.join(shared.few(leaves.select("leaf", F.col("full").alias("epoch"))), "leaf")
    level = [F.from_json("leaf", "array<string>")[i].alias(name) for i, name in enumerate(levels)]
    pick = lambda df: df.select("doc_id", *level, "n_tokens", "epoch", "taken")
    return pick(whole).unionByName(pick(part))


def mixed_documents(docs: DataFrame, levels: Mapping[str, Column], weight, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, **more) -> DataFrame:
    """The rows of docs, each as often as epochs take it. Only the documents of boundary buckets are shuffled.

    The last document of a leaf that gives a part of its tokens has the beginning of its text that they stand for;
    other columns, such as a length, stay as they are.
    """
    _, leaves, edge = plan(docs, levels, weight, id_col=id_col, text_col=text_col, tokenizer=tokenizer, **more)
    taken = _taken(_place(docs, levels, id_col, text_col).filter(F.col("text").rlike(r"[^\p{IsWhite_Space}]")), leaves)
    whole = taken.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs")))).select("_row.*")
    # Of rows that repeat id and text, as many stay as the edge has, one of them cut where the edge has it cut.
    number = lambda *by: F.row_number().over(Window.partitionBy("leaf", "row").orderBy(*by))
    wanted = edge.select("leaf", "row", "n_tokens", "taken", number(F.desc("taken")).alias("which"))
    met = taken.filter("edge").withColumn("which", number("h")).join(wanted, ["leaf", "row", "which"])
    path, columns = tokenizer or token_ids.default_tokenizer(), docs.columns

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = token_ids.encoder(path).head
        for pdf in batches:
            yield pd.DataFrame({"leaf": pdf["leaf"], "text": [first(t, int(n)) for t, n in zip(pdf["text"], pdf["taken"])]})

    # At most one row a leaf is cut.
    cut = met.filter("taken < n_tokens")
    texts = shared.written(cut.select("leaf", "text", "taken").mapInPandas(head, "leaf string, text string"), "mixing-cut").withColumnRenamed("text", "_head")
    short = cut.join(texts, "leaf").select(*[F.col("_head").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in columns])
    return whole.unionByName(met.filter("taken = n_tokens").select("_row.*")).unionByName(short)


def production_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.coalesce("source", F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}


def production_weight(path: tuple[str, ...]) -> float:
    if path in WEIGHTS:
        return WEIGHTS[path]
    return LANGUAGE_WEIGHTS.get(path[1], 1.0) if len(path) == 2 else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents"), production_levels(), production_weight)


SQL = None
