"""Queries and SQL of the operators, by name."""

from . import binary, bytebpe, centroids, decontaminate, hardneg, langid, linedup, lm, mixing, neardup, quality_model, quality_rules, token_counts

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_quality_model": quality_model.op3_quality_model,
    "op4_fair_queue_mix": mixing.op4_fair_queue_mix,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_language_id": langid.op6_language_id,
    "op7_binary_output": binary.op7_binary_output,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_line_alignment": linedup.op9_line_alignment,
    "op10_context_mixing": lm.op10_context_mixing,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_byte_bpe": bytebpe.op12_byte_bpe,
    "op13_annulus_clusters": centroids.op13_annulus_clusters,
}
SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op4_fair_queue_mix": mixing.OP4_SQL,
    "op11_hard_negatives": hardneg.OP11_SQL,
    "op13_annulus_clusters": centroids.OP13_SQL,
}
