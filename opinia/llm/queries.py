"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from opinia.llm import (
    bpe_codec, embedding_dedup, exact_dedup, html_text, lang_id, merkle_manifest, prefix_trie,
    quality_rules, simhash_dedup, source_mixing, token_counts, toxicity,
    url_filter,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op4_bpe_codec": bpe_codec.op4_bpe_codec,
    "op2_language_id": lang_id.op2_language_id,
    "op3_url_filter": url_filter.op3_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_html_text": html_text.op8_html_text,
    "op9_source_mixing": source_mixing.op9_source_mixing,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
