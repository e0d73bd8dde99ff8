"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerflow.llm import byte_pairs, decontaminate, jaccard, language, licenses, neighbours, personal, quality, scoring, sharding

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_wu_manber_decontamination,
        personal.op2_candidate_boosting,
        sharding.op3_sampled_splitters,
        scoring.op4_stupid_backoff,
        byte_pairs.op5_bitmap_rank_queue,
        neighbours.op6_block_matrix_join,
        licenses.op7_license_scan,
        quality.op8_boosted_quality,
        jaccard.op9_ngram_jaccard_join,
        language.op10_cross_parsing_language,
    )
}
ORACLES = {
    "op1_wu_manber_decontamination": decontaminate.ORACLE_SQL,
    "op4_stupid_backoff": scoring.ORACLE_SQL,
    "op6_block_matrix_join": neighbours.ORACLE_SQL,
    "op9_ngram_jaccard_join": jaccard.ORACLE_SQL,
}
