"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in _TEXTS else rows


def spread(scan: DataFrame) -> DataFrame:
    """Deal a small scan out to all cores.

    A text table of one row group is one task however much work its texts are. A scan that
    has a partition per core or more, as any large one has, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as a file table: (doc_id, repo, path, text)."""
    kind = (
        F.when(F.col("doc_id") % 8 == 0, ".py")
        .when(F.col("doc_id") % 8 == 1, ".md")
        .when(F.col("doc_id") % 8 == 2, ".json")
        .when(F.col("doc_id") % 8 == 3, ".ts")
        .when(F.col("doc_id") % 8 == 4, ".csv")
        .when(F.col("doc_id") % 8 == 5, ".log")
        .when(F.col("doc_id") % 8 == 6, ".h")
        .otherwise("")
    )
    path = F.concat(
        F.col("lang"),
        F.when(F.col("doc_id") % 11 == 0, "/build/").otherwise("/"),
        F.lit("doc_"),
        F.col("doc_id").cast("string"),
        kind,
    )
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("repo"), path.alias("path"), "text"
    )


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """pages as a file table; the repo is the host, the path the rest of the URL."""
    parts = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    rest = F.regexp_replace("url", r"^[a-z]+://[^/?#]+/?", "")
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        parts.alias("repo"),
        rest.alias("path"),
        F.col("html").alias("text"),
    )


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as a chunk vector table."""
    label = F.col("label")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("repo"),
        F.col("embedding").alias("vector"),
        label.isin(0, 1, 2, 3, 4).alias("is_code"),
        label.isin(5, 6).alias("is_doc"),
        label.isin(6, 7).alias("is_config"),
        label.isin(8, 9).alias("is_data"),
    )


def as_changes(events: DataFrame) -> DataFrame:
    """events as file changes; works on a static table and on a stream."""
    kind = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "error", "deleted")
        .otherwise("modified")
    )
    return events.select(
        "event_id",
        # The wall times are UTC whatever the session's time zone is.
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp").alias("ts"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"),
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        kind.alias("event_type"),
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return as_changes(table(spark, folder, "events"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as one JSONL file per conversation, a record per turn.

    A user turn is a prompt, an assistant turn an answer with its role as signature, a
    system turn free text.
    """
    role = F.col("role")
    record = (
        F.when(role == "user", F.to_json(F.struct(F.col("text").alias("prompt"), "role")))
        .when(
            role == "assistant",
            F.to_json(F.struct(F.col("role").alias("sig"), F.col("text").alias("answer"))),
        )
        .otherwise(F.to_json(F.struct("turn", F.col("text").alias("note"))))
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", record.alias("record"))
    return turns
