"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, tokens.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from certamap.llm import bpe, mix, quality, secrets, simhash
from certamap.llm.common import cut, table

STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", simhash.stage),
    ("secret_scan", secrets.stage),
    ("source_mix", mix.stage),
    ("byte_bpe", bpe.stage),
]

#: None: fingerprints, the network's spans and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
