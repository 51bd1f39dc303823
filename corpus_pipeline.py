"""The corpus pipeline: quality rules, quality classifier, near-duplicates, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import durable, release, table
from plumbline.llm.decontaminate import remove_contaminated
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality_classifier import filter_by_classifier
from plumbline.llm.quality_rules import filter_quality
from plumbline.llm.simhash import dedup

STAGES = [
    ("quality_rules", filter_quality),
    ("quality_classifier", filter_by_classifier),
    ("simhash_near_dedup", dedup),
    ("benchmark_decontamination", remove_contaminated),
    ("best_fit_packing", pack_documents),
]

#: A quadratic discriminant, fingerprints and tokenised packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass; every stage is written and read again, and deleted once the next one
    is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
