"""Corpus pipeline: quality classifier, language ID, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last keep the columns of documents. Between
stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import common, dedup, langid, packing, quality

STAGES = [
    ("quality classifier", quality.keep_good),
    ("language ID", langid.keep_known),
    ("MinHash near-dedup", dedup.keep_one),
    ("best-fit packing", packing.packed),
]

#: No SQL: trained models, signatures and tokenizers are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
