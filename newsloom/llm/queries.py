"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import bpe, fillmiddle, jaccard, langid, linededup, maxscore, merkle, neighbours, packing, quality, suffixdedup, tokencount, toxicity

QUERIES = {
    "op1_maxscore_topk": maxscore.op1,
    "op2_token_counts": tokencount.op2,
    "op3_language_id": langid.op3,
    "op4_ngram_jaccard": jaccard.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_suffix_dedup": suffixdedup.op6,
    "op7_quality_rules": quality.op7,
    "op8_bpe": bpe.op8,
    "op9_line_dedup": linededup.op9,
    "op10_toxicity": toxicity.op10,
    "op11_fill_in_middle": fillmiddle.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_quality_classifier": neighbours.op13,
}

ORACLE_SQL = {
    "op1_maxscore_topk": maxscore.OP1_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op11_fill_in_middle": fillmiddle.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
