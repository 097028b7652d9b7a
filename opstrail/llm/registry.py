"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

import corpus_pipeline
from opstrail.llm import (
    conversation_repair,
    fingerprints,
    mixing,
    packing,
    periodic_runs,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    topk,
    toxicity,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_pii": pii.op3_pii,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_simhash": simhash.op10_simhash,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_topk": topk.op12_topk,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE_OP1,
    "op3_pii": pii.ORACLE_OP3,
    "op4_mixing": mixing.ORACLE_OP4,
    "op5_substring_dedup": substring_dedup.ORACLE_OP5,
    "op12_topk": topk.ORACLE_OP12,
}
