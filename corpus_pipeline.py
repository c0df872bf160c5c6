"""The corpus pipeline: documents in, token ids of the kept ones out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chargeaudit.llm.common import table, written
from chargeaudit.llm.decontaminate import decontamination_stage
from chargeaudit.llm.near_join import near_stage
from chargeaudit.llm.quality import quality_stage
from chargeaudit.llm.secrets import secret_stage
from chargeaudit.llm.tokens_bpe import bpe_stage

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", bpe_stage),
]

# Robust estimates, similarity groups, tiling and merges are beyond SQL: tests/llm holds the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
