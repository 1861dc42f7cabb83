"""Corpus pipeline: quality rules, line dedup, near-copy removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.llm.common import drop_path, mark, new_scratch_path, release, scratch_at, table

STAGES = [
    ("quality_rules", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("jaccard_dedup", stages.jaccard_dedup),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: SQL can't express the trained line labelling or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; every result but the last is written and read again, and goes once the next one is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since, path = mark(), new_scratch_path(spark, f"pipeline-{name}")
        docs = scratch_at(stage(spark, docs, sf_dir), path)
        release(spark, since, (path,))
        if held:
            drop_path(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
