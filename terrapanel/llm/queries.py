"""The queries of this folder: name -> (spark, sf_dir) -> DataFrame, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from terrapanel.llm import (automaton_dedup, bond_negatives, boosted_quality, context_mixing, decontamination, harmonic_packing, hyperdimensional_language,
                            license_sentences, ngram_jaccard, risk_rules, square_catching, suffix_dedup, warc_revisits)

QUERIES = {
    "op1_context_mixing": context_mixing.op1_context_mixing,
    "op2_harmonic_packing": harmonic_packing.op2_harmonic_packing,
    "op3_boosted_quality": boosted_quality.op3_boosted_quality,
    "op4_hyperdimensional_language": hyperdimensional_language.op4_hyperdimensional_language,
    "op5_license_sentences": license_sentences.op5_license_sentences,
    "op6_warc_revisits": warc_revisits.op6_warc_revisits,
    "op7_risk_rules": risk_rules.op7_risk_rules,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_ngram_jaccard": ngram_jaccard.op9_ngram_jaccard,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_automaton_dedup": automaton_dedup.op11_automaton_dedup,
    "op12_bond_negatives": bond_negatives.op12_bond_negatives,
    "op13_square_catching": square_catching.op13_square_catching,
}

SQL = {
    "op5_license_sentences": license_sentences.SQL,
    "op6_warc_revisits": warc_revisits.SQL,
    "op9_ngram_jaccard": ngram_jaccard.SQL,
    "op11_automaton_dedup": automaton_dedup.SQL,
    "op12_bond_negatives": bond_negatives.SQL,
    "op13_square_catching": square_catching.SQL,
}
