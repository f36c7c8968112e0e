"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from roadlens.llm import alignment, ann, bpe, exact_dedup, hard_negatives, language_id, line_dedup, lm_score, mixing, packing, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_nearest_vectors": ann.query,
    "op4_language_id": language_id.query,
    "op5_lm_score": lm_score.query,
    "op6_source_mix": mixing.query,
    "op7_packing": packing.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_url_filter": url_filter.query,
    "op10_simhash": simhash.query,
    "op11_alignment": alignment.query,
    "op12_bpe_trie": bpe.query,
    "op13_hard_negatives": hard_negatives.query,
}
SQL = {"op2_line_dedup": line_dedup.SQL, "op6_source_mix": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL, "op9_url_filter": url_filter.SQL, "op13_hard_negatives": hard_negatives.SQL}
