"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, exact_dedup, hamming_search, language_id, mixing, ngram_join, packing, suffix_dedup, token_counts, token_ids, url_filter, vector_codes, warc

MODULES = {
    "op1_best_fit_packing": packing,
    "op2_exact_top_k": hamming_search,
    "op4_exact_dedup": exact_dedup,
    "op3_ngram_join": ngram_join,
    "op5_mixing": mixing,
    "op6_suffix_dedup": suffix_dedup,
    "op7_token_counts": token_counts,
    "op8_url_filters": url_filter,
    "op9_language_id": language_id,
    "op10_warc": warc,
    "op11_token_ids": token_ids,
    "op12_collocations": collocations,
    "op13_vector_codes": vector_codes,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if module.SQL}
