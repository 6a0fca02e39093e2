"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, html, language, licenses, merkle, minhash, mixing, quality, repair, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_chat_rotation": chat.op2_chat_rotation,
    "op3_html_extract": html.op3_html_extract,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_url_filter": urls.op5_url_filter,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": language.op9_language_id,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

#: Queries without an entry are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_rotation": chat.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
