"""A training-data pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontaminate, language, line_templates, near_dups, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language.with_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template an earlier document has."""
    kept = line_templates.deduplicated_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Documents without a letter went with the first stage, so a text without any word is one
    that the line stage emptied, a copy of lines that stay elsewhere: it goes too."""
    worded = F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0d]")
    return near_dups.without_near_duplicates(docs.where(worded))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), edited=True, cut=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    import public_tokenizers

    # Executors also hold what the stages before have left, so workers remember fewer words and
    # nothing between tasks.
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=60_000, keep=False)


STAGES = [
    ("language", known_language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark_free),
    ("packing", packed),
]

# The tokenizer and the model are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textquarry.operators.sizing import staged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
