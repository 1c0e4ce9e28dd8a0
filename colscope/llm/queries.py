"""One query per operator, over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from colscope.llm import codes, exactdedup, fingerprints, htmltext, neardedup, negatives, outliers, packing, passages, sharding, suffixtree, tokens, toxicity

QUERIES = {
    "op1_bpe": tokens.op1_bpe,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_shards": sharding.op3_shards,
    "op4_near": neardedup.op4_near,
    "op5_packing": packing.op5_packing,
    "op6_exact": exactdedup.op6_exact,
    "op7_passages": passages.op7_passages,
    "op8_score": suffixtree.op8_score,
    "op9_html": htmltext.op9_html,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality": outliers.op11_quality,
    "op12_negatives": negatives.op12_negatives,
    "op13_codes": codes.op13_codes,
}

ORACLES = {
    "op4_near": neardedup.ORACLE,
    "op6_exact": exactdedup.ORACLE,
    "op12_negatives": negatives.ORACLE,
    "op13_codes": codes.ORACLE,
}
