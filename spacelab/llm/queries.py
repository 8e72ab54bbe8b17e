"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontam, html_text, licenses, lm_score, minhash, packing, phrases, quality, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_sharding": sharding.op3_sharding,
    "op4_html": html_text.op4_html,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_top_k": topk.op7_top_k,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_licenses": licenses.op10_licenses,
    "op11_phrases": phrases.op11_phrases,
    "op12_minhash": minhash.op12_minhash,
}

ORACLE = {
    "op1_decontamination": decontam.ORACLE,
    "op2_lm_score": lm_score.ORACLE,
    "op4_html": html_text.ORACLE,
    "op7_top_k": topk.ORACLE,
    "op10_licenses": licenses.ORACLE,
    "op11_phrases": phrases.ORACLE,
}
