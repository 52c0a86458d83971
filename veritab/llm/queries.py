"""Queries and SQL twins of this subpackage; __spark_entry__.py adds them if it can import this module."""

from __future__ import annotations

from veritab.llm import bpe, chat, exact_dedup, html_text, lexical, ngram_join, packing, quality, spelling, suffix_dedup, token_count, token_store, topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_store": token_store.op2_token_store,
    "op3_bpe": bpe.op3_bpe,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_html_text": html_text.op6_html_text,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_chat": chat.op9_chat,
    "op10_topk": topk.op10_topk,
    "op11_spelling": spelling.op11_spelling,
    "op12_search": lexical.op12_search,
    "op13_token_counts": token_count.op13_token_counts,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op10_topk": topk.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_search": lexical.OP12_SQL,
}
