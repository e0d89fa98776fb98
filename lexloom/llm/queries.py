"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lexloom.llm import collocations, conversation_repair, exact_dedup, langid, lm_scoring, mixing, packing, quality_classifier, quality_rules, sharding, simhash, telephony, toxicity

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_sharding": sharding.op2_sharding,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_simhash": simhash.op7_simhash,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_collocations": collocations.op11_collocations,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_telephony": telephony.op13_telephony,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
