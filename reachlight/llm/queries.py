"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from reachlight.llm import bpe, language, lengths, media, neardup, packing, pii, repetition, sharding, toxicity

QUERIES = {
    "op1_media_fingerprints": media.query,
    "op2_quality_repetition": repetition.query,
    "op3_packing": packing.query,
    "op4_token_lengths": lengths.query,
    "op5_near_duplicates": neardup.query,
    "op6_language": language.query,
    "op7_bpe": bpe.query,
    "op8_personal_data": pii.query,
    "op9_toxicity": toxicity.query,
    "op10_sharding": sharding.query,
}

ORACLE_SQL: dict[str, str] = {}
