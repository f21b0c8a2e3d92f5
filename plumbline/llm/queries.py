"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, filter_audit, near_dedup, packing, quality_cnn, quality_rules, resampling, sharding, substring_dedup, suffix_dedup, token_files, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_debruijn_repeats": substring_dedup.op1_debruijn_repeats,
        "op10_byte_cnn": quality_cnn.op10_byte_cnn,
        "op11_mask_histogram": filter_audit.op11_mask_histogram,
        "op12_rank_array": bpe.op12_rank_array,
        "op13_trie_resampling": resampling.op13_trie_resampling,
        "op2_ring_shards": sharding.op2_ring_shards,
        "op3_retrieval_packing": packing.op3_retrieval_packing,
        "op4_dart_minhash": near_dedup.op4_dart_minhash,
        "op5_line_frequency": quality_rules.op5_line_frequency,
        "op6_redirect_verdicts": url_filters.op6_redirect_verdicts,
        "op7_spaced_seeds": decontaminate.op7_spaced_seeds,
        "op8_radix_windows": suffix_dedup.op8_radix_windows,
        "op9_wavelet_shards": token_files.op9_wavelet_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_debruijn_repeats": substring_dedup.OP1_SQL,
        "op11_mask_histogram": filter_audit.OP11_SQL,
        "op13_trie_resampling": resampling.OP13_SQL,
        "op5_line_frequency": quality_rules.OP5_SQL,
        "op6_redirect_verdicts": url_filters.OP6_SQL,
        "op7_spaced_seeds": decontaminate.OP7_SQL,
        "op8_radix_windows": suffix_dedup.OP8_SQL,
    }
