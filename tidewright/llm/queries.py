"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module, and whether the module has ORACLE SQL for it.
_QUERIES = {
    "op1_decontaminate": ("decontaminate", None),
    "op2_language_id": ("langid", None),
    "op3_sentencepiece": ("pieces", None),
    "op4_chat_format": ("chat", "OP4_SQL"),
    "op5_token_shards": ("sstable", None),
    "op6_lm_score": ("masked_lm", None),
    "op7_exact_dedup": ("exact_dedup", "OP7_SQL"),
    "op8_toxicity": ("toxicity", None),
    "op9_warc": ("warc", None),
    "op10_jaccard_join": ("jaccard_join", None),
    "op11_lexical_search": ("wavelet", "OP11_SQL"),
    "op12_fingerprints": ("fingerprints", None),
    "op13_periodic_runs": ("runs", None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in _QUERIES.items() if sql}
