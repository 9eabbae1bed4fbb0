"""The subpackage's queries and their SQL."""

from __future__ import annotations

from sparkloom.llm import embedding_dedup, lang_id, mixing, near_dedup, packing, pii, quality, repetition, token_output, warc_index

QUERIES = {
    "op1_language_id": lang_id.op1_language_id,
    "op10_embedding_pairs": embedding_dedup.op10_embedding_pairs,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_packing": packing.op4_packing,
    "op5_token_output": token_output.op5_token_output,
    "op6_warc_index": warc_index.op6_warc_index,
    "op7_suffix_repetition": repetition.op7_suffix_repetition,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_pii": pii.op9_pii,
}
ORACLES: dict[str, str] = {"op10_embedding_pairs": embedding_dedup.ORACLE, "op2_mixing": mixing.ORACLE, "op6_warc_index": warc_index.ORACLE}
