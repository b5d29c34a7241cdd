"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, html, language, mixing, simhash, suffix, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language.query,
    "op2_topk_search": topk.query,
    "op3_toxicity": toxicity.query,
    "op4_suffix_dedup": suffix.query,
    "op5_chat_format": chat.query,
    "op6_simhash_dedup": simhash.query,
    "op7_html_extract": html.query,
    "op8_mix_sources": mixing.query,
    "op9_byte_bpe": bpe.query,
    "op10_fingerprint": fingerprints.query,
}
SQL: dict[str, str] = {
    "op2_topk_search": topk.SQL,
    "op5_chat_format": chat.SQL,
    "op8_mix_sources": mixing.SQL,
    "op10_fingerprint": fingerprints.SQL,
}
