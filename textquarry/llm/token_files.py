"""Token files: ids of whole texts in Simple-8b words, in ascending document order."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from ..session import shared_folder
from . import simple8b
from .registry import query, table
from .tokens import encoder

MAGIC = b"TQS8B001"
END_ID = 2
SHARD_IDS = 1 << 24
_GROUP = simple8b.BLOCK * 512  # ids encoded at once
_KEPT = 200_000  # parts of words in one generation of a worker's cache

_MANIFEST = "part int, shard int, file string, n_docs long, n_ids long"


class ShardWriter:
    """One file: MAGIC, the length of a JSON header and the header, then the sections it lists:
    doc_id (int64), known (uint8, 0 where doc_id is null), n_tokens (uint32), block_words
    (uint32, words of each block of ids) and words (uint64), all little-endian."""

    def __init__(self):
        self.doc_ids, self.n_tokens, self.words, self.block_words = [], [], [], []
        self.open, self.n_open, self.n_ids = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(values))
        self.open.append(values)
        self.n_open += len(values)
        self.n_ids += len(values)
        if self.n_open >= _GROUP:
            self._encode(self.n_open - self.n_open % simple8b.BLOCK)

    def _encode(self, n: int) -> None:
        values = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        words, block_words = simple8b.encode(values[:n])
        self.words.append(words)
        self.block_words.append(block_words)
        self.open, self.n_open = [values[n:]], len(values) - n

    def content(self) -> bytes:
        self._encode(self.n_open)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        sections = {
            "doc_id": np.array([d or 0 for d in self.doc_ids], "<i8"),
            "known": known,
            "n_tokens": np.array(self.n_tokens, "<u4"),
            "block_words": np.concatenate(self.block_words).astype("<u4"),
            "words": np.concatenate(self.words).astype("<u8"),
        }
        header = {"n_ids": self.n_ids, "sections": {k: [v.dtype.str, len(v)] for k, v in sections.items()}}
        head = json.dumps(header).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(v.tobytes() for v in sections.values())])


def read_shard(content: bytes | memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids of a file."""
    if bytes(content[:8]) != MAGIC:
        raise ValueError("not a token file")
    at = 12 + int.from_bytes(content[8:12], "little")
    header = json.loads(bytes(content[12:at]))
    part = {}
    for name, (dtype, n) in header["sections"].items():
        part[name] = np.frombuffer(content, dtype, n, at)
        at += part[name].nbytes
    ids = simple8b.decode(part["words"], part["block_words"], header["n_ids"], np.uint32)
    doc_ids = [d if k else None for d, k in zip(part["doc_id"].tolist(), part["known"].tolist())]
    return doc_ids, part["n_tokens"].astype(np.int64), ids.astype("<u4", copy=False)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encode ``text`` of every row and write token files to a folder that executors share.

    Rows go in ascending order of (doc_id, text), null ids first; a null text is empty and a
    repeated row is written again. Returns the manifest, a row per file in order of ``part``
    and ``shard``. A task that runs again writes the same files in place.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        where, root = files.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context, enc, done = TaskContext.get(), encoder(tokenizer, _KEPT), []
        part, attempt = context.partitionId(), context.taskAttemptId()
        end = np.array([end_id], "<u4").tobytes()

        def close(shard: ShardWriter) -> None:
            name = f"{part:07d}-{len(done):05d}.s8b"
            with where.open_output_stream(f"{root}/.{name}-{attempt}") as out:
                out.write(shard.content())
            where.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            done.append((part, len(done), name, len(shard.doc_ids), shard.n_ids))

        shard = ShardWriter()
        for batch in batches:
            encoded = enc.encode_all(t.as_py() for t in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                shard.add(doc_id, ids + end)
                if shard.n_ids >= shard_ids:
                    close(shard)
                    shard = ShardWriter()
        if shard.doc_ids:
            close(shard)
        if done:
            columns = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "shard", "file", "n_docs", "n_ids"],
            )

    return staged(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens
    and its ids as little-endian unsigned 32-bit integers."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("shard_start"))
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, ids = read_shard(memoryview(batch.column("content")[i].as_buffer()))
                file = batch.column("file")[i].as_py()
                ends = np.cumsum(counts)
                for a in range(0, len(doc_ids), 2000):
                    b = min(a + 2000, len(doc_ids))
                    first = ends[a] - counts[a]
                    offsets = np.concatenate([[0], ends[a:b] - first]) * 4
                    body = ids[first : ends[b - 1]].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * (b - a), pa.string()),
                            pa.array(doc_ids[a:b], pa.int64()),
                            pa.array(ends[a:b] - counts[a:b], pa.int64()),
                            pa.array(counts[a:b], pa.int64()),
                            pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(body)]),
                        ],
                        ["file", "doc_id", "local_start", "n_tokens", "ids"],
                    )

    docs = content.mapInArrow(read, "file string, doc_id long, local_start long, n_tokens long, ids binary")
    return docs.join(broadcast_if_small(starts), "file").select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


@query("op4_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, f"token-files-{uuid.uuid4().hex[:12]}")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
