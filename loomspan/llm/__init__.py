"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import conversations, jaccard, line_dedup, lm_score, media, mixing, packing, pii_crf, quality, sort_means, suffix_dedup, token_files, warc


def queries():
    return {
        "op1_repeated_strings": suffix_dedup.query,
        "op2_skip_chain_pii": pii_crf.query,
        "op3_media_archives": media.query,
        "op4_warc_normaliser": warc.query,
        "op5_source_mixing": mixing.query,
        "op6_simple8b_token_files": token_files.query,
        "op7_best_fit_packing": packing.query,
        "op8_token_group_join": jaccard.query,
        "op9_cross_entropy_difference": lm_score.query,
        "op10_decision_list": quality.query,
        "op11_conversation_repair": conversations.query,
        "op12_sort_means": sort_means.query,
        "op13_line_dedup": line_dedup.query,
    }


def oracle_sql():
    return {"op4_warc_normaliser": warc.ORACLE_SQL, "op12_sort_means": sort_means.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
