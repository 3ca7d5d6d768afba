"""Queries of the pipeline operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, decontam, embdedup, langid, licenses, lmscore, simhash, suffixdedup, tokenbin, urlfilter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_token_binary": tokenbin.op3_token_binary,
    "op4_lm_scoring": lmscore.op4_lm_scoring,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_url_filters": urlfilter.op7_url_filters,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_embedding_near_dedup": embdedup.op10_embedding_near_dedup,
}

ORACLE_SQL = {
    "op9_benchmark_decontamination": decontam.ORACLE,
    "op10_embedding_near_dedup": embdedup.ORACLE,
}
