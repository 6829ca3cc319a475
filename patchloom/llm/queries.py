"""Registered queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import chat, decontaminate, html_extract, langid, lm_score, mixing, ngram_jaccard, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_langid": langid.op2_langid,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_quality": quality.op6_quality,
    "op7_html": html_extract.op7_html,
    "op8_chat": chat.op8_chat,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_quality": quality.OP6_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
