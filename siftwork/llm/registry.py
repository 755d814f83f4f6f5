"""Queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

from siftwork.llm import bpe_codec, conversation_repair, divergence, embedding_dedup, graph_search, html_extract, line_dedup, minhash_dedup, mixing, quality, sentencepiece_codec, substring_dedup, url_filter

QUERIES = {
    "op1_minhash_near_dedup": minhash_dedup.op1_minhash_near_dedup,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_embedding_near_dedup": embedding_dedup.op5_embedding_near_dedup,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_nearest_neighbours": graph_search.op10_nearest_neighbours,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_bpe": bpe_codec.op12_bpe,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_minhash_near_dedup": minhash_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_embedding_near_dedup": embedding_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_nearest_neighbours": graph_search.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
