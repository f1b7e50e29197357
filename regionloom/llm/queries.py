"""The queries of this subpackage and their SQL (where SQL can express them)."""

from __future__ import annotations

from . import bpe, conversations, encoding, langid, lines, lm, media, mixing, neighbours, quality, simhash, suffix, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_media_columns": media.op4_media_columns,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_suffix_array_dedup": suffix.op8_suffix_array_dedup,
    "op9_url_filters": urls.op9_url_filters,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_target_encoding": encoding.op11_target_encoding,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_prefix_trie": conversations.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_quality_rules": quality.OP2_SQL,
    "op3_lm_scoring": lm.OP3_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op8_suffix_array_dedup": suffix.OP8_SQL,
    "op9_url_filters": urls.OP9_SQL,
    "op11_target_encoding": encoding.OP11_SQL,
    "op13_prefix_trie": conversations.OP13_SQL,
}
