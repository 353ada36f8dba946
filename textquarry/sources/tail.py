"""The last lines of log files, read from their ends."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tree import clamp_tail

BLOCK = 1 << 16  # bytes read at a time
TAIL = "file string, back int, text string"


def last_lines(file: BinaryIO, size: int, n: int, block: int = BLOCK) -> list[str]:
    """The last ``n`` lines of an open file, oldest first, as text with U+FFFD for broken bytes.

    Blocks are read from the end until they hold n line feeds beside one that ends the file;
    what lies before them is not read. A carriage return before a line feed is no part of
    a line.
    """
    blocks: list[bytes] = []
    at, feeds = size, 0
    while at > 0 and feeds <= n:
        start = max(0, at - block)
        file.seek(start)
        blocks.append(file.read(at - start))
        feeds += blocks[-1].count(b"\n")
        at = start
    held = b"".join(reversed(blocks))
    lines = held.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[-n:]]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LogTail(DataSource):
    """``spark.read.format("log_tail").option("files", json).option("lines", n)``: the last lines
    of each file, a partition per file. Files are URIs or paths that every executor reaches."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL

    def reader(self, schema) -> _TailReader:
        return _TailReader(self.options)


class _TailReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.lines = clamp_tail(options.get("lines"))
        self.block = int(options.get("block", BLOCK))

    def partitions(self):
        return [_File(path) for path in self.files]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if "://" in part.path or part.path.startswith("file:"):
            system, path = fs.FileSystem.from_uri(part.path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
        else:
            system, path = fs.LocalFileSystem(), part.path
        with system.open_input_file(path) as file:
            lines = last_lines(file, file.size(), self.lines, self.block)
        back = pa.array(range(len(lines), 0, -1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines)), back, pa.array(lines, pa.string())], [x.split()[0] for x in TAIL.split(", ")])


def tail_files(spark: SparkSession, path: str | list[str], n=200, block: int = BLOCK) -> DataFrame:
    """(file, back, text): the last ``n`` lines of every text file below ``path``, ``back`` 1 being
    the last line of its file. What is read follows the lines asked for, not the files' sizes.

    ``n`` is kept between 1 and 2000; what is no number means 200. Files are listed by Spark;
    an empty one has no row.
    """
    files = sorted(spark.read.text(path).inputFiles())
    spark.dataSource.register(LogTail)
    return (
        spark.read.format("log_tail")
        .option("files", json.dumps(files))
        .option("lines", clamp_tail(n))
        .option("block", block)
        .load()
    )


def log_end(tails: DataFrame, n=200) -> DataFrame:
    """The last ``n`` lines of a log that goes on from file to file in order of their names,
    oldest first, from :func:`tail_files` of as many lines."""
    last = tails.orderBy(F.desc("file"), "back").limit(clamp_tail(n))
    return last.orderBy("file", F.desc("back"))
