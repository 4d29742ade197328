"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import ann, chat, exact, html, minhash, mixing, packing, periodic, quality, substring, suffix, warc, whitening

_MODULES = {
    "op1_chat_format": chat,
    "op2_suffix_dedup": suffix,
    "op3_warc": warc,
    "op4_nearest_neighbours": ann,
    "op5_main_text": html,
    "op6_substring_dedup": substring,
    "op7_quality_rules": quality,
    "op8_minhash_near_dedup": minhash,
    "op9_best_fit_packing": packing,
    "op10_mix_sources": mixing,
    "op11_embedding_whitening": whitening,
    "op12_exact_dedup": exact,
    "op13_periodic_runs": periodic,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
