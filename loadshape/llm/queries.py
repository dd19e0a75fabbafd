"""Queries of this package by name, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from . import collocations, decontamination, exact_dedup, jaccard_join, line_templates, merkle, mixing, packing, quality_rules, substring_dedup, surrogates, token_file, toxicity

QUERIES = {
    "op1_suffix_array_dedup": substring_dedup.op1_suffix_array_dedup,
    "op2_packing": packing.op2_packing,
    "op3_line_templates": line_templates.op3_line_templates,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_file": token_file.op5_token_file,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_pii_surrogates": surrogates.op9_pii_surrogates,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_collocations": collocations.op11_collocations,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_decontamination": decontamination.op13_decontamination,
}
ORACLE = {
    "op1_suffix_array_dedup": substring_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
