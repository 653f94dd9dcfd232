"""A corpus from raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: toxic documents go, repeated passages are
cut out line by line, one document of each near-duplicate group stays, documents that hold a
benchmark passage go, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.llm import decontamination, line_dedup, packing, simhash, toxicity
from poolsift.session import pin


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labels of these documents."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages; the character count follows the text."""
    done = line_dedup.remove_repeats(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their training sequences."""
    return packing.pack(docs).drop("row", "ids")


STAGES = [
    ("toxicity", civil),
    ("line_dedup", fresh_lines),
    ("simhash", distinct_texts),
    ("decontamination", uncontaminated),
    ("packing", packed),
]
#: Learning the toxicity model is no SQL; tests/llm compares the stages with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
