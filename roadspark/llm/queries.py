"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import chat, extraction, fingerprints, jaccard, langid, licenses, mixing, packing, quality, topk


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {"op1_quality_bayes": quality.query, "op2_merkle_fingerprints": fingerprints.query, "op3_ngram_jaccard": jaccard.query, "op4_chat_perspectives": chat.query, "op5_wrapper_extraction": extraction.query, "op6_hilbert_packing": packing.query, "op7_license_scan": licenses.query, "op8_source_mixing": mixing.query, "op9_exact_topk": topk.query, "op10_language_viterbi": langid.query}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, for what SQL can express."""
    return {"op4_chat_perspectives": chat.SQL, "op7_license_scan": licenses.SQL, "op8_source_mixing": mixing.SQL, "op9_exact_topk": topk.SQL}
