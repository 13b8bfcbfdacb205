"""The corpus pipeline: rule filtering, line dedup, near-dedup, decontamination and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last
returns the columns of documents. Language references, line counts, near-duplicate groups and benchmark
matches are thus those of a stage's own input.

Defined results: rows of a null id pass every stage but quality rules like unrelated documents; null and
empty texts fail quality rules; an empty table packs into no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from quantsieve.llm._shared import table, with_code


@with_code
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.quality_filter(docs, **quality_rules.PRODUCTION)


@with_code
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat across them."""
    return line_dedup.line_dedup(docs, min_chars=40, min_docs=5).select(*docs.columns)


@with_code
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8."""
    gone = near_dedup.similar_groups(docs, k=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("_qs_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_qs_gone"), "left_anti")


@with_code
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


@with_code
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]
#: SQL can't express tokenising, nor the connected components at this size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
