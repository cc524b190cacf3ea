"""A training-data pipeline of five corpus operators over the documents of a folder.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. Stages and their
decisions: toxic documents go; of equal texts the smallest id stays; of each near-duplicate component the smallest
id stays; documents with benchmark passages go; what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, exact_dedup, minhash_dedup, packing, toxicity
from quern.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely not toxic than toxic, by an ordinal model of the labelled ones' severity."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, toxicity.severity_grades(table(spark, sf_dir, "labels")), "severity"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row of the smallest id; null and empty texts are one group.

    Rows without an id lose against any id; of rows that repeat id and text one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of the smallest id; texts without words stay. Null ids lose."""
    return minhash_dedup.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words (or a whole shorter item) of the benchmark. Empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is the end token alone, and null ids stay null."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: A fitted model and a tokenizer are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
