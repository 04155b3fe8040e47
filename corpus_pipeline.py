"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firmlens.llm import line_quality, packing, personal_data, simhash
from firmlens.llm.registry import table
from firmlens.llm.scratch import stored

STAGES = [
    ("quality_rules", line_quality.stage),
    ("near_duplicates", simhash.stage),
    ("personal_data", personal_data.stage),
    ("packing", packing.stage),
]

#: The trained models, the hash and the tokenizer have no SQL form; the tests follow every document through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents in turn; each result is written and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
