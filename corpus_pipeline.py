"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import stages
from attestry.llm.common import stored, table

STAGES = [
    ("quality rules", stages.keep_quality),
    ("line dedup", stages.drop_lines),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("suffix-array dedup", stages.drop_repeats),
    ("packing", stages.pack_tokens),
]

#: Hash-based learning, similarity joins and byte-pair encoding aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, each written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
