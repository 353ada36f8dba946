"""Debounce file changes: a path is reported once it has been quiet, with its last change."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.ignore import event_dropped, ignore_decision, rule_arrays, table_match
from ..operators.sizing import broadcast_if_small

KEY = ["repo", "path"]
EVENT_TYPES = ("created", "modified", "deleted")


def kept_events(
    events: DataFrame,
    *,
    include: list[str] = (),
    gitignore: list[str] = (),
    skip_dirs: Iterable[str] = fixed.WATCH_SKIP_DIRS,
    skip_extensions: Iterable[str] = fixed.WATCH_SKIP_EXTENSIONS,
    include_match: Column | None = None,
    gitignore_match: Column | None = None,
    **rules,
) -> DataFrame:
    """Events worth looking at. Removals only pass the directory prefilter: a file that is
    gone cannot be judged by its size. A ``size`` column is used when there is one."""
    patterns = dict(
        include=include,
        gitignore=gitignore,
        include_match=include_match,
        gitignore_match=gitignore_match,
    )
    known = events.where(F.col("event_type").isin(*EVENT_TYPES)).where(
        ~event_dropped("path", skip_dirs=skip_dirs, **patterns)
    )
    sized = known if "size" in known.columns else known.withColumn("size", F.lit(0).cast("long"))
    decision = ignore_decision(
        "path",
        "size",
        skip_dirs=skip_dirs,
        skip_extensions=skip_extensions,
        **patterns,
        **rules,
    )
    return (
        sized.withColumn("__d", decision)
        .where((F.col("event_type") == "deleted") | ~F.col("__d.ignored"))
        .select(*events.columns)
    )


def watched(events: DataFrame, options: DataFrame) -> DataFrame:
    """Events of the repos being watched; ``options`` has (repo, watch)."""
    return events.join(broadcast_if_small(options.where("watch").select("repo")), "repo", "left_semi")


def kept_by_repo(
    events: DataFrame,
    options: DataFrame,
    ignore_patterns: DataFrame,
    include_patterns: DataFrame | None = None,
    **rules,
) -> DataFrame:
    """:func:`kept_events` where every repo brings its own options and patterns.

    ``options`` has (repo, watch, respect_gitignore); pattern tables have (repo, ord,
    pattern). All of them are static and small, the events may be a stream.
    """
    columns = events.columns
    chosen = options.where("watch").select("repo", "respect_gitignore")
    joined = events.join(broadcast_if_small(chosen), "repo")
    git = broadcast_if_small(rule_arrays(ignore_patterns).withColumnRenamed("rules", "__git"))
    joined = joined.join(git, "repo", "left")
    included = F.lit(False)
    if include_patterns is not None:
        own = broadcast_if_small(rule_arrays(include_patterns).withColumnRenamed("rules", "__inc"))
        joined = joined.join(own, "repo", "left")
        included = table_match("path", F.col("__inc"))
    ignored = F.col("respect_gitignore") & table_match("path", F.col("__git"))
    kept = kept_events(joined, include_match=included, gitignore_match=ignored, **rules)
    return kept.select(*columns)


def debounce_stream(
    events: DataFrame,
    gap: str = f"{fixed.DEBOUNCE_SECONDS:g} seconds",
    *,
    watermark: str = "1 minute",
) -> DataFrame:
    """One row per quiet period of a path on a stream: (repo, path, event_type, events,
    first_ts, last_ts). Events exactly ``gap`` apart still belong together."""
    order = _order(events)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap), *KEY)
        .agg(
            F.max_by("event_type", order).alias("event_type"),
            F.count("*").alias("events"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select(*KEY, "event_type", "events", "first_ts", "last_ts")
    )


def split_late(events: DataFrame, seen_until, delay: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """(in time, late): events of a micro-batch by whether a watermark of ``delay`` behind
    ``seen_until``, the newest event of all earlier micro-batches, has passed them. With
    ``seen_until`` None none is late."""
    if seen_until is None:
        return events, events.where(F.lit(False))
    passed = F.col("ts") < F.lit(seen_until).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    return events.where(~F.coalesce(passed, F.lit(False))), events.where(passed)


def record_late(events: DataFrame, folder: str, checkpoint: str, delay: str = "1 minute", trigger: dict | None = None):
    """Start a stream beside :func:`debounce_stream` on the same events that writes each event
    too late for its watermark to ``<folder>/late/epoch=<n>``, so that none goes uncounted.

    The newest event of each micro-batch is kept in ``<folder>/seen``; one that is tried again
    compares with the epochs before it and writes the same rows.
    """
    spark = events.sparkSession

    def one_batch(rows: DataFrame, epoch: int) -> None:
        seen = None
        if epoch > 0:
            seen = spark.read.parquet(f"{folder}/seen").where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        _, late = split_late(rows, seen, delay)
        late.write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{folder}/seen/epoch={epoch}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one_batch)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def _order(events: DataFrame):
    return F.struct("ts", "event_id") if "event_id" in events.columns else F.col("ts")


def debounce_batch(
    events: DataFrame, gap_seconds: float = fixed.DEBOUNCE_SECONDS, bucket_seconds: float | None = None
) -> DataFrame:
    """The batch form of :func:`debounce_stream`, safe for a path with most of the events.

    Events of a path within one gap-sized bin always belong together, so they are folded
    first, in each task before the shuffle. Quiet periods are then found inside time buckets
    of a path, and only the first and last period of a bucket, which may go on in the
    neighbour, meet again in one group.
    """
    gap = int(gap_seconds * 1_000_000)
    bins_per_bucket = max(1, int(bucket_seconds * 1_000_000) // gap) if bucket_seconds else 4096
    micros = F.unix_micros("ts")
    folded = (
        events.withColumn("us", micros)
        .withColumn("bin", ((F.col("us") - F.pmod("us", F.lit(gap))) / gap).cast("long"))
        .groupBy(*KEY, "bin")
        .agg(
            F.max(F.struct(_order(events).alias("at"), "event_type")).alias("last"),
            F.count("*").alias("events"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
        .withColumn("bucket", F.floor(F.col("bin") / bins_per_bucket))
    )
    inside = _joined_periods(folded, [*KEY, "bucket"], gap)
    edges = Window.partitionBy(*KEY, "bucket")
    tagged = inside.withColumn(
        "edge",
        (F.col("first_us") == F.min("first_us").over(edges))
        | (F.col("first_us") == F.max("first_us").over(edges)),
    )
    across = _joined_periods(tagged.where("edge").drop("edge"), KEY, gap)
    closed = tagged.where(~F.col("edge")).drop("edge", "bucket")
    return across.unionByName(closed).select(
        *KEY,
        F.col("last.event_type").alias("event_type"),
        "events",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
    )


def _joined_periods(rows: DataFrame, groups: list[str], gap: int) -> DataFrame:
    """Join neighbouring periods of a group that lie at most ``gap`` apart."""
    w = Window.partitionBy(*groups).orderBy("first_us")
    starts = F.col("first_us") - F.lag("last_us").over(w) > gap
    return (
        rows.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("long"))
        .withColumn("__period", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*groups, "__period")
        .agg(
            F.max("last").alias("last"),
            F.sum("events").alias("events"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
        )
        .drop("__period")
    )
