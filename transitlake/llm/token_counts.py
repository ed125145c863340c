"""Operator 7: token counts with a whole-token shortcut.

Offline, every vocabulary string that splits into itself and encodes alone as one token is proved so with the
library. A text's pre-tokens that are in this set count one each; only the rest goes through the merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LIMIT = 512
#: Lengths of merged pre-tokens that a task keeps at hand; the memo is emptied when full.
MEMO = 500_000
#: Pre-tokens of up to so many characters are kept in the memo.
MEMO_CHARS = 64


class WholeTokenCounter:
    """Counts the tokens of texts as a byte-level BPE tokenizer file of the tokenizers library gives them."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        space = r"\p{White_Space}"
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?!\P{{White_Space}})|{space}+").findall
        self.whole = self.prove()
        self.memo: dict[str, int] = {}

    def prove(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and that the library encodes as exactly one token."""
        decoder = self.tokenizer.decoder
        strings = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            text = decoder.decode([token])
            if "�" not in text and self.pieces(text) == [text]:
                strings.append(text)
        encoded = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)

    def merge(self, piece: str) -> int:
        """Tokens of a pre-token outside the set, by the library's merges."""
        n = self.memo.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def plain(self, text: str) -> int:
        pieces, whole, memo = self.pieces(text), self.whole, self.memo
        n = len(pieces)
        for p in pieces:
            if p not in whole:
                n += (memo.get(p) or self.merge(p)) - 1
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def counter(path: str) -> WholeTokenCounter:
    return shared.held(("token counts", path), lambda: WholeTokenCounter(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each. Texts of any length are counted
    whole. tokenizer: a file that executors have at the same place. Nothing is shuffled; other columns are not read.
    """
    path = tokenizer or default_tokenizer()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path).count
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": [count(t) for t in pdf["text"]]})

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.octet_length(shared.text_of(text_col)).cast("long").alias("n_bytes"), shared.text_of(text_col).alias("text"))
    # Ids go through pandas as strings, as a null among numbers would make all of them floating point numbers.
    out = rows.mapInPandas(counted, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(shared.table(spark, sf_dir, "documents"))


SQL = None
