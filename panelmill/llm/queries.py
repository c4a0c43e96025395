"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from panelmill.llm import alignment, bpe, concatenate, exact_dedup, license_scan, ngram_join, packing, quality_rules, resampling, suffix_dedup, token_counts, toxicity, wavelet

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_bpe": bpe.op7_bpe,
    "op8_token_output": wavelet.op8_token_output,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_packing": concatenate.op11_packing,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
}
ORACLES = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_license_scan": license_scan.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
    "op12_importance_resampling": resampling.SQL,
}
