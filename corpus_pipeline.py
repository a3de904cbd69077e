"""The corpus pipeline: documents in, a mixed and tokenised corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrascore.llm.base import stage, table
from terrascore.llm.bpe import bpe_stage
from terrascore.llm.languages import language_stage
from terrascore.llm.mixing import mix_stage
from terrascore.llm.neardup import dedup_stage
from terrascore.llm.secrets import secrets_stage

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language identification", language_stage),
    ("near-duplicates", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing", mix_stage),
    ("byte-pair encoding", bpe_stage),
]
ORACLE_SQL = None  # the stages train models and hash shingles, which SQL can't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
