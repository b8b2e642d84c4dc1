"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from mnemos.llm import bpe, exact_dedup, kneser_ney, license_scan, merkle, minhash, mixing, quality_rules, resampling, simhash, suffix_dedup, tokens, url_filter

QUERIES: dict[str, Callable] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_token_files": tokens.op2_token_files,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_bpe_merge_replay": bpe.op7_bpe_merge_replay,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_kneser_ney_quality": kneser_ney.op9_kneser_ney_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_minhash_near_dedup": minhash.op13_minhash_near_dedup,
}

SQL: dict[str, str] = {
    "op5_license_scan": license_scan.OP5_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
}
