"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import stages
from quire.llm.common import cut, table

STAGES = [
    ("toxicity", stages.clean),
    ("line_dedup", stages.unrepeated_lines),
    ("ngram_join", stages.distinct_documents),
    ("source_mixing", stages.mixed),
    ("packing", stages.packed),
]

#: A trained classifier and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else cut(made)
    return docs
