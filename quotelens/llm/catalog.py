"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from quotelens.llm import bpe, exact_dedup, host_reputation, line_dedup, main_text, packing, quality, search, simhash, spelling, substring_dedup, suffix_dedup, token_files

QUERIES = {
    "op1_best_fit_packing": packing.best_fit_packing,
    "op2_bpe_round_trip": bpe.bpe_round_trip,
    "op3_tag_path_text": main_text.tag_path_text,
    "op4_token_files": token_files.token_files,
    "op5_host_reputation": host_reputation.host_reputation,
    "op6_repetition_coverage": quality.repetition_coverage,
    "op7_substring_dedup": substring_dedup.substring_dedup,
    "op8_simhash_near_dedup": simhash.simhash_near_dedup,
    "op9_exact_dedup": exact_dedup.exact_dedup,
    "op10_suffix_array_dedup": suffix_dedup.suffix_array_dedup,
    "op11_spelling_variants": spelling.spelling_variants,
    "op12_line_dedup": line_dedup.line_dedup,
    "op13_ranked_search": search.ranked_search,
}

CHECKS = {
    "op5_host_reputation": host_reputation.CHECK,
    "op9_exact_dedup": exact_dedup.CHECK,
    "op12_line_dedup": line_dedup.CHECK,
    "op13_ranked_search": search.CHECK,
}
