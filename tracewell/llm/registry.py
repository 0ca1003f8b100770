"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tracewell.llm import chat, decontaminate, fim, fingerprints, html_extract, langid, mixing, neardup, quality, substrings, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_document_fingerprints": fingerprints.op1,
        "op2_benchmark_decontamination": decontaminate.op2,
        "op3_warc": warc.op3,
        "op4_language_id": langid.op4,
        "op5_source_mixing": mixing.op5,
        "op6_html_extraction": html_extract.op6,
        "op7_quality_classifier": quality.op7,
        "op8_toxicity": toxicity.op8,
        "op9_minhash_near_dedup": neardup.op9,
        "op10_chat_formatting": chat.op10,
        "op11_substring_dedup": substrings.op11,
        "op12_fill_in_middle": fim.op12,
        "op13_embedding_whitening": whitening.op13,
        "chat_layouts": chat.chat_layouts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": decontaminate.ORACLE_OP2,
        "op3_warc": warc.ORACLE_OP3,
        "op5_source_mixing": mixing.ORACLE_OP5,
        "op9_minhash_near_dedup": neardup.ORACLE_OP9,
        "op10_chat_formatting": chat.ORACLE_OP10,
        "op11_substring_dedup": substrings.ORACLE_OP11,
        "op12_fill_in_middle": fim.ORACLE_OP12,
        "chat_layouts": chat.ORACLE_LAYOUTS,
    }
