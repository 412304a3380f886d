"""The training-data operators as registered queries, each over its whole table."""

from __future__ import annotations

from hirelake.llm import collocations, edit_embedding, hamming_search, html_text, hyperlang, katz, license_scan, mixing, near_dedup, packing, sharding, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op1_mixing_to_end": mixing.op1_mixing_to_end,
    "op2_sharding": sharding.op2_sharding,
    "op3_html": html_text.op3_html,
    "op4_fingerprints": edit_embedding.op4_fingerprints,
    "similar_documents": edit_embedding.similar_documents_query,
    "op5_topk_search": hamming_search.op5_topk_search,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_packing": packing.op7_packing,
    "op8_lm_scoring": katz.op8_lm_scoring,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_language": hyperlang.op11_language,
    "op12_whitening": whitening.op12_whitening,
    "op13_collocations": collocations.op13_collocations,
}

SQL: dict[str, str] = {"op1_mixing": mixing.OP1_SQL, "op1_mixing_to_end": mixing.OP1_SQL, "op5_topk_search": hamming_search.OP5_SQL, "op13_collocations": collocations.OP13_SQL}
