"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofset.llm import exact_dedup, filter_audit, fingerprints, lang_id, lm_score, media, near_dedup, packing, periodic_runs, pii, quality, sentence_pieces, sharding

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.query,
        "op2_media_columns": media.query,
        "op3_best_fit_packing": packing.query,
        "op4_pii": pii.query,
        "op5_near_dedup": near_dedup.query,
        "op6_sentence_pieces": sentence_pieces.query,
        "op7_lm_score": lm_score.query,
        "op8_language_id": lang_id.query,
        "op9_sharding": sharding.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_fingerprints": fingerprints.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_pii": pii.ORACLE_SQL,
        "op5_near_dedup": near_dedup.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
