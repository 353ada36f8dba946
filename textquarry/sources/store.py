"""Stored tables of an index: parquet folders, one sub-folder per applied batch.

A batch writes its rows under ``<table>/batch=<n>`` and nothing else is touched, so its cost
follows its own size. A document row says which batch holds its postings and symbols
(``content_batch``) and which its vectors (``vector_batch``); ``documents`` is written last
and decides what is live. Writing a batch again replaces its own folders, which makes a
retry harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.sizing import broadcast_if_small, staged

TABLES = {
    "runs": "note string",
    "documents": (
        "doc_id bigint, repo string, path string, blob_sha string, size bigint, language string, "
        "deleted boolean, content_batch int, vector_batch int, vector_indexed_at timestamp, "
        "vector_index_error string"
    ),
    "blobs": "blob_sha string, text string",
    "postings": "gram string, doc_id bigint",
    "symbols": "doc_id bigint, name string, kind string, line int, signature string, scope string",
    "vectors": (
        "doc_id bigint, repo string, path string, chunk_index int, start_line int, end_line int, "
        "content string, vector array<float>, is_code boolean, is_doc boolean, is_config boolean, "
        "is_data boolean, extension string, language string"
    ),
}


class Store:
    """Tables of one index below a folder on a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, table: str, batch: int | None = None) -> str:
        base = f"{self.root}/{table}"
        return base if batch is None else f"{base}/batch={batch}"

    def reserve(self, note: str = "") -> int:
        """A batch number that no run has used or begun to use. Each number is claimed by a
        folder of its own, so two runs at a time do not get the same one."""
        used = [self.log(t).agg(F.max("batch").alias("n")).first()["n"] for t in ("runs", "documents")]
        batch = max([-1, *(n for n in used if n is not None)]) + 1
        while True:
            try:
                claim = self.spark.createDataFrame([(note,)], TABLES["runs"])
                claim.write.mode("error").parquet(self.folder("runs", batch))
                return batch
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                batch += 1

    def discard(self, table: str, batch: int) -> None:
        """Remove a batch's folder of a table that only helped to write others."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder(table, batch))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, table: str, batch: int, rows: DataFrame) -> None:
        fields = self.spark.createDataFrame([], TABLES[table]).schema
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
        rows.select(*columns).write.mode("overwrite").parquet(self.folder(table, batch))

    def log(self, table: str) -> DataFrame:
        """All rows ever written, with their ``batch``."""
        schema = f"{TABLES[table]}, batch int"
        try:
            return self.spark.read.schema(schema).option(
                "basePath", self.folder(table)
            ).parquet(self.folder(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batch_rows(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self.folder(table, batch))

    def documents(self, before: int | None = None) -> DataFrame:
        """The live documents: the newest row of each (repo, path) unless it is a removal;
        with ``before``, as they were ahead of that batch."""
        log = self.log("documents")
        if before is not None:
            log = log.where(F.col("batch") < before)
        newest = Window.partitionBy("repo", "path").orderBy(F.desc("batch"))
        return (
            log.withColumn("__n", F.row_number().over(newest))
            .where((F.col("__n") == 1) & ~F.coalesce("deleted", F.lit(False)))
            .drop("__n", "deleted")
        )

    def live(self, table: str) -> DataFrame:
        """Derived rows (postings, symbols, vectors) of live documents."""
        at = "vector_batch" if table == "vectors" else "content_batch"
        current = self.documents().select("doc_id", F.col(at).alias("batch"))
        return self.log(table).join(current, ["doc_id", "batch"], "left_semi").drop("batch")

    def _kept(self, table: str) -> DataFrame:
        """:meth:`live` for reading a whole table. What is not live is little as a rule: the keys
        of that are found first, and the rows themselves are not shuffled to meet the documents."""
        at = "vector_batch" if table == "vectors" else "content_batch"
        current = self.documents().select("doc_id", F.col(at).alias("batch"))
        log = self.log(table).where(F.col("doc_id").isNotNull())
        keys = log.select("doc_id", "batch").distinct()
        dead = staged(keys.join(current, ["doc_id", "batch"], "left_anti"), f"dead-{table}")
        return log.join(broadcast_if_small(dead), ["doc_id", "batch"], "left_anti").drop("batch")

    def blobs(self) -> DataFrame:
        """Contents that a live document uses (unused ones are gone from every reading)."""
        used = self.documents().select("blob_sha").distinct()
        log = self.log("blobs")
        # What is not wanted, contents without a document and second copies that two runs at a
        # time have written, is little as a rule: it goes to the texts, and no text is shuffled.
        keys = staged(log.select("blob_sha", "batch"), "blob-keys")
        first = keys.join(used, "blob_sha", "left_semi").groupBy("blob_sha").agg(F.min("batch").alias("batch"))
        unwanted = staged(keys.join(first, ["blob_sha", "batch"], "left_anti").distinct(), "unwanted-blobs")
        return log.join(broadcast_if_small(unwanted), ["blob_sha", "batch"], "left_anti").drop("batch")

    def files(self, doc_ids: DataFrame | None = None) -> DataFrame:
        """Live documents with their text, all or those in ``doc_ids``.

        Chosen documents that measure small reach the blobs by broadcast: the blobs are then
        scanned, not shuffled.
        """
        docs = self.documents().select("doc_id", "repo", "path", "blob_sha")
        if doc_ids is None:
            return docs.join(self.blobs(), "blob_sha")
        wanted = broadcast_if_small(doc_ids.select("doc_id").distinct())
        docs = broadcast_if_small(docs.join(wanted, "doc_id", "left_semi"))
        return self.log("blobs").drop("batch").join(docs, "blob_sha")

    def compact(self, target: str) -> Store:
        """Write only what is live into a new folder as one batch; switch readers to it.

        Postings are laid out by gram range (a very common gram spans several files), so a
        search reads only the files and row groups that hold its grams.
        """
        out = Store(self.spark, target)
        docs = self.documents()
        out.write("blobs", 0, self.blobs())
        postings = self._kept("postings").repartitionByRange("gram", "doc_id")
        out.write("postings", 0, postings.sortWithinPartitions("gram", "doc_id"))
        out.write("symbols", 0, self._kept("symbols"))
        out.write("vectors", 0, self._kept("vectors"))
        moved = {
            "deleted": F.lit(False),
            "content_batch": F.lit(0),
            "vector_batch": F.when(F.col("vector_batch").isNotNull(), 0),
        }
        out.write("documents", 0, docs.withColumns(moved))
        return out
