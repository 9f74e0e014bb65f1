"""Training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage reads the whole of what the stage before it kept, from Parquet, and writes Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from lexloom.llm.common import shared_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that ten or more documents have; n_chars follows.  A document that loses all its lines stays, empty."""
    rows = line_dedup.dedup_lines(docs)
    text = F.col("row.text")
    values = {"text": F.when(text.isNull(), text).otherwise(F.col("kept")), "n_chars": F.length("kept").cast("long")}
    return rows.select(*[values[c].alias(c) if c in values else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal or similar texts (five-word shingles, Jaccard 0.8) the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: The exact similarity and the alignment of two stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, name.replace(" ", "-"))
    return docs
