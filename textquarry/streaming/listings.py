"""A change stream from listings of files: differences of neighbouring snapshots.

Each listing that is recorded becomes a numbered snapshot, and what changed since the one
before is written beside it. The stream reads these changes as they come, so its offsets
follow the snapshots, a stream that starts anew replays all of them, and nothing has to
watch the files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.files import DOC_KEY, detect_changes
from ..sources.tree import list_tree

CHANGES = "repo string, path string, event_type string, ts timestamp, snapshot int"
_LISTING = "repo string, path string, blob_sha string"
_EVENTS = {"new": "created", "changed": "modified", "deleted": "deleted"}


class Listings:
    """Snapshots below a folder that all executors share: ``listings/snapshot=n`` and
    ``changes/snapshot=n``. One writer at a time; any number of streams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        schema = schema if "snapshot" in schema else f"{schema}, snapshot int"
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def newest(self) -> int:
        """Number of the last snapshot whose changes are written; -1 before the first."""
        done = self._read("done", "at timestamp").agg(F.max("snapshot").alias("n")).first()["n"]
        return -1 if done is None else done

    def snapshot(self, n: int) -> DataFrame:
        """(repo, path, blob_sha) of the n-th listing; before the first it is empty."""
        if n < 0:
            return self.spark.createDataFrame([], _LISTING)
        return self.spark.read.schema(_LISTING).parquet(f"{self.folder}/listings/snapshot={n}")

    def record(self, listing: DataFrame, at: datetime | None = None) -> int:
        """Store a listing (repo, path, and blob_sha or size) as the next snapshot, write what
        changed and return its number.

        ``at`` is the time of the changes, now unless given. A file without a mark (null
        blob_sha or size) could not be read and stays as it was. After a run that failed
        before its snapshot was marked as done, the next one takes the same number: the
        listing is written again, and the changes of that number that no file has yet.
        """
        n = self.newest() + 1
        mark = "blob_sha" if "blob_sha" in listing.columns else "size"
        seen = listing.select(*DOC_KEY, F.col(mark).cast("string").alias("blob_sha"))
        seen = seen.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).dropDuplicates(DOC_KEY)
        before = self.snapshot(n - 1)
        unread = before.join(seen.where("blob_sha IS NULL").select(*DOC_KEY), DOC_KEY, "left_semi")
        now = seen.where("blob_sha IS NOT NULL").unionByName(unread)
        now.write.mode("overwrite").parquet(f"{self.folder}/listings/snapshot={n}")
        moment = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        kinds = F.create_map(*(F.lit(x) for pair in _EVENTS.items() for x in pair))
        changes = detect_changes(before, self.snapshot(n)).select(
            *DOC_KEY, F.try_element_at(kinds, F.col("change")).alias("event_type"), moment.alias("ts"), F.lit(n).alias("snapshot")
        )
        changes = changes.where("event_type IS NOT NULL")
        # Files that a run left there before it failed may be in a stream already: only rows
        # that are missing are added.
        there = self._read("changes", CHANGES).where(F.col("snapshot") == n)
        if there.head(1):
            changes = changes.join(there.select(*DOC_KEY), DOC_KEY, "left_anti").select(*changes.columns)
        changes.write.mode("append").parquet(f"{self.folder}/changes")
        self.spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{self.folder}/done/snapshot={n}")
        return n

    def poll(self, roots: dict[str, str], partitions: int = 64) -> int:
        """Record what file trees (repo name to directory) hold now, by path and size."""
        return self.record(list_tree(self.spark, roots, partitions).select(*DOC_KEY, "size"))

    def changes(self, after: int = -1) -> DataFrame:
        """All recorded changes (repo, path, event_type, ts, snapshot) after a snapshot."""
        return self._read("changes", CHANGES).where(F.col("snapshot") > after)

    def stream(self, **options) -> DataFrame:
        """The changes as a stream, in the shape that :mod:`debounce` and :mod:`timers` take.
        Options, such as ``maxFilesPerTrigger``, are those of Spark's file stream."""
        folder = f"{self.folder}/changes"
        if not self._read("changes", CHANGES).head(1):
            self.spark.createDataFrame([], CHANGES).write.mode("append").parquet(folder)
        return self.spark.readStream.schema(CHANGES).options(**options).parquet(folder)
