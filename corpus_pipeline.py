"""A corpus pipeline of five stages, each an operator of panelwright.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import common, stages

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup_stage),
    ("simhash_near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixing", stages.source_mix),
]

#: Components of near copies and the shards of the mix are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
