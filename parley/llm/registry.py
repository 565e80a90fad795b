"""The queries of the operators in this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from parley.llm import decontamination, exact_dedup, hard_negatives, html_text, jaccard_join, licences, media, mixing, pii, quality, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": licences.op2_license_scan,
    "op3_media_columns": media.op3_media_columns,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_pii": pii.op8_pii,
    "op9_html_text": html_text.op9_html_text,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_license_scan": licences.sql(),
    "op6_mix_sources": mixing.sql(),
    "op10_substring_dedup": substring_dedup.sql(),
    "op11_exact_dedup": exact_dedup.sql(),
}
