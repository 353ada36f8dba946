"""Broadcast only what is measured to be small."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

BROADCAST_BYTES = 32 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as text, by one aggregate job that brings back one number."""
    width = sum(
        (F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c in df.columns),
        F.lit(0),
    )
    row = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return int(row["bytes"])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast when it measures below ``limit``; otherwise leave the
    choice (a shuffle join, split on skew by AQE) to Spark."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: a result that was costly to find
    is found once, and losing an executor does not lose it."""
    folder = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
