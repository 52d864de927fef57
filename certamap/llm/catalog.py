"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from certamap.llm import bpe, html_text, mix, pii, quality, secrets, shard, simhash, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": pii.query,
        "op2_html_main_text": html_text.query,
        "op3_byte_bpe": bpe.query,
        "op4_secret_scan": secrets.query,
        "op5_vector_neardup": vectors.query,
        "op6_toxicity": toxicity.query,
        "op7_simhash_neardup": simhash.query,
        "op8_quality_rules": quality.query,
        "op9_source_mixing": mix.query,
        "op10_kdtree_sharding": shard.query,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {k: v for k, v in {"op8_quality_rules": quality.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
