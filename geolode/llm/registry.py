"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from geolode.llm import bpe, chat, covertree, licences, mixing, partenum, ppm, quality, rules, secrets

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_chat_format": chat.op3_chat_format,
    "op4_license_scan": licences.op4_license_scan,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_lm_score": ppm.op6_lm_score,
    "op7_ngram_jaccard": partenum.op7_ngram_jaccard,
    "op8_embedding_near_dedup": covertree.op8_embedding_near_dedup,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_secret_scan": secrets.op10_secret_scan,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
    "op3_chat_format": chat.SQL,
    "op4_license_scan": licences.SQL,
    "op5_quality_rules": rules.SQL,
    "op7_ngram_jaccard": partenum.SQL,
    "op8_embedding_near_dedup": covertree.SQL,
}
