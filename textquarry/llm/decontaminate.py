"""Benchmark decontamination by spaced-seed hashing and verified overlaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from .registry import query, table
from .rows import fresh
from .words import mix, word_hashes
from .worker import row_slices, shared, text_buffers

WINDOW = 16  # aligned words that are compared
ALIKE = 13  # of them, words that must be equal
SHORTEST = 5  # words of the shortest item that is looked for
# Masks over word positions; 0 is ignored. Whatever three of 16 words differ, one of these
# masks fits somewhere on equal words, so no overlap is lost before it is verified.
MASKS = ("1101111", "1110111", "110100000111")
# Items below WINDOW words have these too: whatever words may differ in 5 to 15, one fits.
SHORT_MASKS = ("1111", "11011")
PASS_HASHES = 1 << 21  # benchmark hashes carried to the tasks at once, 16 MB
_FILTER_BITS = 22
_SLICE = 1 << 21


def _weights() -> np.ndarray:
    return mix(np.arange(1, 64, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def needed(n: int) -> int:
    """Equal words that make an overlap with an item of ``n`` words: ALIKE of WINDOW, and the
    same share, rounded up, of a shorter item."""
    return -(-ALIKE * min(n, WINDOW) // WINDOW)


def seeds(words: np.ndarray, ends: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of every mask at every place of every text. Hashes of different
    masks differ."""
    w = shared("seed weights", _weights)
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(words))
    for shape, mask in enumerate(masks):
        taken, span = [i for i, c in enumerate(mask) if c == "1"], len(mask)
        at = np.flatnonzero(room >= span)
        if not len(at):
            continue
        n = len(words) - span + 1
        total = np.full(n, shape + 1, np.uint64)
        for i in taken:
            total += words[i : i + n] * w[i]
        yield at, mix(total[at])


def _item_rows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, at, hash, words): seeds of the item, and all its word hashes."""
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_hashes(*text_buffers(batch.column("text")), bare=True)
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = words[ends[i] : ends[i + 1]]
                n = len(own)
                if item is None or n < SHORTEST:
                    continue
                found = list(seeds(own, np.array([0, n]), MASKS if n >= WINDOW else MASKS + SHORT_MASKS))
                at = np.concatenate([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(at), pa.int64()),
                        pa.array(at, pa.int32()),
                        pa.array(np.concatenate([f[1] for f in found]).view(np.int64)),
                        pa.array([own.tobytes()] * len(at), pa.binary()),
                    ],
                    ["item_id", "at", "hash", "words"],
                )

    return rows.mapInArrow(cut, "item_id long, at int, hash long, words binary").distinct()


def leaks(
    docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", item_text: str = "text", edited: bool = False, cut: bool = False
) -> DataFrame:
    """(doc_id, text_hash, item_id, start, alike): for each row of ``docs`` and benchmark item
    that overlap, the first word of the document's best overlap and its equal words.

    Words are bare: lower-cased in A-Z, and ASCII punctuation parts them. A document overlaps
    an item of WINDOW words or more where ALIKE of WINDOW words in line are equal, a shorter
    one where it holds all its words in a row or, if ``edited``, the same share of them in
    line (:func:`needed`). With ``cut`` a window may lie partly before the start or behind the
    end of the document, where no word is equal; otherwise it lies inside. Items below SHORTEST words, null texts and null item ids overlap
    with nothing. ``text_hash`` is xxhash64 of the text: with doc_id, which
    may be null or repeated, it tells rows apart. Other columns are not read.

    Benchmark hashes go to the tasks in passes of a bounded size, so that of the documents'
    hashes only those found in the benchmark are joined.
    """
    spark = docs.sparkSession
    bench = staged(_item_rows(items, item_key, item_text), "benchmark-seeds")
    n = bench.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, alike int")
    short = bench.where(F.octet_length("words") < 8 * WINDOW).limit(1).count()
    masks = MASKS + SHORT_MASKS if short else MASKS
    passes = -(-n // PASS_HASHES)
    found = None
    for turn in range(passes):
        mine = bench.where(F.pmod("hash", F.lit(passes)) == turn)
        hashes = np.unique(mine.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))
        part = _hits(docs, hashes, masks)
        found = part if found is None else found.unionByName(part)
    found = staged(found, "seed-hits")

    hits = found.select("segment", F.explode("hits").alias("hit")).select("segment", "hit.hash", "hit.at")
    lines = hits.join(broadcast_if_small(bench.select("hash", "item_id", F.col("at").alias("item_at"))), "hash")
    lines = lines.select("segment", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    texts = bench.select("item_id", F.col("words").alias("item_words")).distinct()
    pairs = lines.join(broadcast_if_small(texts), "item_id").join(found.drop("hits"), "segment")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for i in range(batch.num_rows):
                mine = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                item = np.frombuffer(batch.column("item_words")[i].as_py(), np.uint64)
                places.append(best_overlap(mine, item, batch.column("shift")[i].as_py(), edited, cut))
            keep = pa.array([p[1] > 0 for p in places])
            first = batch.column("first").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    batch.column("item_id"),
                    pa.array(first + np.array([p[0] for p in places]), pa.int32()),
                    pa.array([p[1] for p in places], pa.int32()),
                ],
                ["doc_id", "text_hash", "item_id", "start", "alike"],
            ).filter(keep)

    seen = pairs.select("doc_id", "text_hash", "item_id", "shift", "first", "words", "item_words").mapInArrow(
        verify, "doc_id long, text_hash long, item_id long, start int, alike int"
    )
    best = seen.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("alike", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("start"), F.col("best.alike").alias("alike"))


def best_overlap(mine: np.ndarray, item: np.ndarray, shift: int, edited: bool = False, cut: bool = False) -> tuple[int, int]:
    """Place in ``mine`` of the best window when the item starts at ``shift``, and its equal
    words; 0 where no window is alike enough."""
    n = len(item)
    a, b = max(shift, 0), min(shift + n, len(mine))
    window, least = min(n, WINDOW), ALIKE if n >= WINDOW else n
    least = needed(n) if edited else least
    if cut and least <= b - a:  # shorter only at an end of the document: segments hold two windows
        window = min(window, b - a)
    if b - a < window:
        return 0, 0
    equal = np.concatenate([[0], np.cumsum(mine[a:b] == item[a - shift : b - shift])])
    alike = equal[window:] - equal[:-window]
    at = int(alike.argmax())
    return a + at, int(alike[at]) if alike[at] >= least else 0


def _hits(docs: DataFrame, hashes: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """Segments of documents around places whose hashes the benchmark has: every word that a
    window over a hit can hold, once, with the hits in it."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    sent, key = docs.sparkSession.sparkContext.broadcast(hashes), uuid.uuid4().hex

    def table_of() -> tuple[np.ndarray, np.ndarray]:
        known = sent.value
        near = np.zeros(1 << _FILTER_BITS, bool)
        near[known >> np.uint64(64 - _FILTER_BITS)] = True
        return known, near

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, near = shared("benchmark hashes", table_of, key)
        segment = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                words, ends = word_hashes(*text_buffers(batch.column("text")), bare=True)
                at, got = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for place, value in seeds(words, ends, masks):
                    maybe = np.flatnonzero(near[value >> np.uint64(64 - _FILTER_BITS)])
                    slot = np.minimum(np.searchsorted(known, value[maybe]), len(known) - 1)
                    maybe = maybe[known[slot] == value[maybe]]
                    at.append(place[maybe])
                    got.append(value[maybe])
                at, got = np.concatenate(at), np.concatenate(got)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, got = at[order], got[order]
                doc = np.searchsorted(ends, at, side="right") - 1
                # A hit begins a segment where its document has none within two windows.
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * WINDOW)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                lo = np.maximum(at[first] - WINDOW, ends[doc[first]])
                hi = np.minimum(at[last] + 2 * WINDOW, ends[doc[first] + 1])
                pick = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment + np.arange(len(first)), pa.int64()),
                        batch.column("doc_id").take(pick),
                        batch.column("text_hash").take(pick),
                        pa.array(lo - ends[doc[first]], pa.int32()),
                        pa.array([words[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()),
                        pa.array(
                            [
                                [{"hash": h, "at": p} for h, p in zip(got[i : j + 1].view(np.int64).tolist(), (at[i : j + 1] - a).tolist())]
                                for i, j, a in zip(first.tolist(), last.tolist(), lo.tolist())
                            ],
                            pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])),
                        ),
                    ],
                    ["segment", "doc_id", "text_hash", "first", "words", "hits"],
                )
                segment += len(first)

    return rows.select("doc_id", "text_hash", "text").mapInArrow(
        find,
        "segment long, doc_id long, text_hash long, first int, words binary, hits array<struct<hash:long, at:int>>",
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", item_text: str = "text", edited: bool = False, cut: bool = False
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that overlap no benchmark item."""
    found = staged(leaks(docs, items, item_key=item_key, item_text=item_text, edited=edited, cut=cut), "leaks")
    leak_id, leak_hash = fresh(docs, "leak_id", "leak_hash")
    bad = broadcast_if_small(found.select("doc_id", "text_hash").distinct().toDF(leak_id, leak_hash))
    text_hash = F.xxhash64(docs["text"].cast("string"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(leak_id)) & (text_hash == F.col(leak_hash))
    return docs.join(bad, same, "left_anti")


@query("op1_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edited=True, cut=True)
    return found.select("doc_id", "item_id", "start", "alike", F.lit(True).alias("contaminated"))
