"""The queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, html_extract, language_id, mixing, ngram_join, permutation_index, token_counts, toxicity, url_rules
from .common import tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: language_id.op1_language_id(tables(s, d, "documents")),
        "op2_bpe": lambda s, d: bpe.op2_bpe(tables(s, d, "documents")),
        "op3_token_counts": lambda s, d: token_counts.op3_token_counts(tables(s, d, "documents")),
        "op4_toxicity": lambda s, d: toxicity.op4_toxicity(tables(s, d, "documents"), tables(s, d, "labels")),
        "op5_mixing": lambda s, d: mixing.op5_mixing(tables(s, d, "documents"), tables(s, d, "labels")),
        "op6_embedding_dedup": lambda s, d: embedding_dedup.op6_embedding_dedup(tables(s, d, "embeddings")),
        "op7_permutation_index": lambda s, d: permutation_index.op7_permutation_index(tables(s, d, "embeddings")),
        "op8_ngram_join": lambda s, d: ngram_join.op8_ngram_join(tables(s, d, "documents")),
        "op9_url_rules": lambda s, d: url_rules.op9_url_rules(tables(s, d, "pages"), tables(s, d, "labels")),
        "op10_html_extract": lambda s, d: html_extract.op10_html_extract(tables(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.OP5_SQL, "op6_embedding_dedup": embedding_dedup.OP6_SQL, "op8_ngram_join": ngram_join.OP8_SQL}
