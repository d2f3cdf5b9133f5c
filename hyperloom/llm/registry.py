"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from hyperloom.llm.decontaminate import op5_decontamination
from hyperloom.llm.fingerprint import op10_canonical_digest
from hyperloom.llm.language import op8_byte_cnn_language
from hyperloom.llm.lengths import op7_length_histogram
from hyperloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from hyperloom.llm.mixing import OP1_SQL, op1_source_mixing
from hyperloom.llm.neardup import op4_minmax_near_dedup
from hyperloom.llm.negatives import OP12_SQL, op12_segment_negatives
from hyperloom.llm.personal import op13_weak_supervision_pii
from hyperloom.llm.quality import op2_bradley_terry_quality
from hyperloom.llm.scoring import op6_log_bloom_lm
from hyperloom.llm.secrets import op9_token_efficiency
from hyperloom.llm.sharding import op3_flow_reshard


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_bradley_terry_quality": op2_bradley_terry_quality,
        "op3_flow_reshard": op3_flow_reshard,
        "op4_minmax_near_dedup": op4_minmax_near_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_log_bloom_lm": op6_log_bloom_lm,
        "op7_length_histogram": op7_length_histogram,
        "op8_byte_cnn_language": op8_byte_cnn_language,
        "op9_token_efficiency": op9_token_efficiency,
        "op10_canonical_digest": op10_canonical_digest,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_segment_negatives": op12_segment_negatives,
        "op13_weak_supervision_pii": op13_weak_supervision_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op11_merkle_manifest": OP11_SQL, "op12_segment_negatives": OP12_SQL}
