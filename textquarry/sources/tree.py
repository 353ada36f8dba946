"""Scan file trees.

Spark's own file sources leave out names that begin with ``_`` or ``.``, which a source
tree is full of. Listing is a small Data Source with one partition per group of
directories; reading is a separate step, after ignore rules have had their say, spread
evenly over tasks however the files lie in the tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


LISTING = "repo string, path string, size bigint, root string"
_LISTING_NAMES = [x.split()[0] for x in LISTING.split(", ")]


class _Listing(InputPartition):
    def __init__(self, repo: str, root: str, folder: str, deep: bool):
        self.repo, self.root, self.folder, self.deep = repo, root, folder, deep


class FileTree(DataSource):
    """``spark.read.format("file_tree").option("roots", json)``: one row per regular file.

    ``roots`` is a JSON object from repo name to directory; every executor must see the
    directories under the same path.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        import json

        self.roots = json.loads(options["roots"])
        self.partitions_wanted = int(options.get("partitions", "64"))

    def partitions(self):
        """Open directories level by level until there are enough parts of the tree."""
        done: list[_Listing] = []
        open_parts = [(repo, root, root) for repo, root in sorted(self.roots.items())]
        while open_parts and len(done) + len(open_parts) < self.partitions_wanted:
            deeper = []
            for repo, root, folder in open_parts:
                done.append(_Listing(repo, root, folder, False))
                deeper += [(repo, root, e.path) for e in _entries(folder) if e.is_dir(follow_symlinks=False)]
            open_parts = deeper
        return done + [_Listing(*p, True) for p in open_parts]

    def read(self, part: _Listing) -> Iterator[pa.RecordBatch]:
        folders = [part.folder]
        while folders:
            rows = []
            for e in _entries(folders.pop()):
                if e.is_dir(follow_symlinks=False):
                    if part.deep:
                        folders.append(e.path)
                    continue
                try:
                    if e.is_file():
                        rows.append((part.repo, os.path.relpath(e.path, part.root), e.stat().st_size, part.root))
                except OSError:
                    continue  # gone since the folder was read
            if rows:
                columns = zip(*rows)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _LISTING_NAMES)


def _entries(folder: str) -> list[os.DirEntry]:
    """Entries of a folder; none where it may not be opened or is gone."""
    try:
        with os.scandir(folder) as entries:
            return list(entries)
    except OSError:
        return []


def list_tree(spark: SparkSession, roots: dict[str, str], partitions: int = 64) -> DataFrame:
    """(repo, path, size, root) of every regular file below the roots."""
    import json

    spark.dataSource.register(FileTree)
    return (
        spark.read.format("file_tree")
        .option("roots", json.dumps(roots))
        .option("partitions", partitions)
        .load()
    )


def read_tree(listing: DataFrame, tasks: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Add ``content`` and ``error`` to listed files.

    A file above ``max_bytes``, or one that is gone or cannot be read, has a null content and
    says why in ``error``; :func:`operators.files.detect_changes` does not take it for deleted.
    """
    spread = listing.repartition(tasks) if tasks else listing.repartition(F.col("repo"), F.col("path"))
    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    names = listing.columns
    at = {c: names.index(c) for c in ("root", "path", "size")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(at[c]).to_pylist() for c in ("root", "path", "size")])
            start, held, content, errors = 0, 0, [], []
            for root, path, size in rows:
                data, error = None, None
                if max_bytes is not None and size > max_bytes:
                    error = f"larger than {max_bytes} bytes"
                else:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            data = f.read()
                    except OSError as e:
                        error = e.strerror or type(e).__name__
                content.append(data)
                errors.append(error)
                held += len(data or b"")
                if held > 64 << 20:
                    yield _with_content(batch, start, content, errors, names)
                    start, held, content, errors = start + len(content), 0, [], []
            if content:
                yield _with_content(batch, start, content, errors, names)

    return spread.mapInArrow(read, schema)


def _with_content(batch: pa.RecordBatch, start: int, content: list, errors: list, names: list[str]):
    part = batch.slice(start, len(content))
    return pa.RecordBatch.from_arrays(
        [*part.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())], [*names, "content", "error"]
    )


# --- pattern files --------------------------------------------------------------------------------

IGNORE_FILES = (".gitignore", ".git/info/exclude")
INCLUDE_FILES = (".index_include",)


def pattern_table(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(repo, ord, pattern) from the pattern files at each repo's root.

    ``files`` has (repo, path, text). Files are taken in the order of ``names``, lines are
    stripped, blank lines and comments dropped.
    """
    from ..functions.text import lines, strip

    place = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    return (
        files.where(F.col("path").isin(*names))
        .select("repo", place.alias("file"), F.posexplode(lines("text")).alias("pos", "raw"))
        .select(
            "repo",
            (F.col("file") * (1 << 32) + F.col("pos")).alias("ord"),
            strip("raw").alias("pattern"),
        )
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
    )


def tree_footprint(listing: DataFrame) -> DataFrame:
    return listing.groupBy("repo").agg(F.sum("size").alias("bytes"))


# --- log files --------------------------------------------------------------------------------------


def clamp_tail(n, default: int = 200, most: int = 2000) -> int:
    """Number of lines asked for, kept between 1 and ``most``; not a number: the default."""
    try:
        return max(1, min(int(n), most))
    except (TypeError, ValueError):
        return default


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, row, text): the lines of text files with what orders them.

    ``at`` is where a task's part of the file begins and ``row`` rises within the part.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )


def log_tail(log: DataFrame, n=200, order: str | list[str] = "line") -> DataFrame:
    """The last lines of a log table by its ``order`` columns, oldest first."""
    by = [order] if isinstance(order, str) else order
    return log.orderBy(*[F.desc(c) for c in by]).limit(clamp_tail(n)).orderBy(*by)
