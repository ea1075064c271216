"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing, over whole tables.

Edge cases.  Every stage decides row by row, also where ids repeat or are null.  A null or empty text
has no words, so the quality rules drop it; line dedup may leave an empty text, which later stages keep
as a document without words until mixing, which takes none of it.  Equal rows are one document after
near-duplicate removal, and come again only as often as the mix takes them.  All columns of documents
are carried along, whatever further ones there are, up to packing, which returns pieces.  Empty tables
give an empty result; without labels of both kinds only the base conditions reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules
from voxloom.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions or the learnt rules reject go."""
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text."""
    out = line_dedup.without_common_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id (null after all); five-word shingles, similarity 0.8."""
    return minhash_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources takes them, in the order of virtual finish time."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL cannot tokenise, nor learn rules; tests/llm/test_pipeline.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
