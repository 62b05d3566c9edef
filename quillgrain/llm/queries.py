"""The registered queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from quillgrain.llm import best_fit, fim, line_dedup, mtree, oracles, pieces, pii, ppm, quality_rules, ranked_search, sharding, simhash_dedup, substring_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_mtree": mtree.query,
    "op4_pii": pii.query,
    "op5_ppm": ppm.query,
    "op6_pieces": pieces.query,
    "op7_best_fit": best_fit.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_sharding": sharding.query,
    "op12_ranked_search": ranked_search.query,
    "op13_fill_in_middle": fim.query,
}
ORACLES: dict[str, str] = {
    "op3_mtree": mtree.ORACLE,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op9_quality_rules": oracles.QUALITY_RULES,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
