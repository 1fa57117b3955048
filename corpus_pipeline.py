"""A corpus from raw documents: leave out toxic ones, exact copies and near copies, mix the sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwatch.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from lotwatch.llm.common import drop_table, materialize, table

#: Each takes the documents that the one before it left; all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: Toxicity is a trained model: the rows can't be said in SQL, and tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the Parquet that the one before it wrote."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            drop_table(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
