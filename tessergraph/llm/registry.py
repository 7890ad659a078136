"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessergraph.llm import bpe, chat, decontamination, embeddings, html, licenses, packing, phrases, quality, sharding, simhash, substrings


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embeddings.query,
        "op2_byte_bpe": bpe.query,
        "op3_license_scan": licenses.query,
        "op4_html_extraction": html.query,
        "op5_best_fit_packing": packing.query,
        "op6_substring_dedup": substrings.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_sharding": sharding.query,
        "op9_chat_format": chat.query,
        "op10_quality_rules": quality.query,
        "op11_phrase_mining": phrases.query,
        "op12_decontamination": decontamination.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_embedding_near_dedup": embeddings.ORACLE_SQL,
        "op6_substring_dedup": substrings.ORACLE_SQL,
        "op9_chat_format": chat.ORACLE_SQL,
        "op10_quality_rules": quality.ORACLE_SQL,
        "op11_phrase_mining": phrases.ORACLE_SQL,
        "op12_decontamination": decontamination.ORACLE_SQL,
    }
