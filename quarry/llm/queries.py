"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quarry.llm import divergence, fill_in_middle, html_extract, media, mixing, packing, piece_bpe, quality_classifier, quality_rules, setsketch, sharding, suffix_dedup, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_media": media.op3_media,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_piece_bpe": piece_bpe.op6_piece_bpe,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_setsketch": setsketch.op9_setsketch,
    "op10_sharding": sharding.op10_sharding,
    "op11_packing": packing.op11_packing,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
