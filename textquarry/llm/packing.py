"""Best-fit packing of token pieces into sequences, certified by lower bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import staged
from .registry import query, table
from .tokens import KEPT, encoder
from .worker import released

CAPACITY = 1024
END_ID = 2
GROUP = 4096  # pieces packed together
ROUNDS = 6

_PIECES = "piece_key long, doc_id long, piece int, start long, length int, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = KEPT, keep: bool = True
) -> DataFrame:
    """Pieces of every document's ids and its end id, a row each: piece_key (unique), doc_id,
    piece, start, length and ids (little-endian unsigned 32-bit).

    Only documents longer than ``capacity`` are cut; the first piece takes what the others,
    of ``capacity`` ids each, leave. A null text is empty, and each repeated row is packed.
    ``cached`` bounds the pieces of words that a worker remembers, between tasks too if ``keep``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, cached), np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((key, doc_id, piece, a, b - a, ids[4 * a : 4 * b]))
                    key += 1
                held += len(ids)
                if held > 1 << 22:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return rows.mapInArrow(cut if keep else released(cut), _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each of the lengths, which come in descending order, and the room
    left in each bin. A length goes into the fullest bin that takes it."""
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has exactly r left
    bins, offsets, left = [], [], []
    for n in lengths:
        above = filled >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = levels[room].pop()
            if not levels[room]:
                filled ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        rest = room - n
        left[b] = rest
        if rest:
            levels[rest].append(b)
            filled |= 1 << rest
    return bins, offsets, left


def bin_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can stay below, by dual-feasible functions.

    Each function maps lengths so that whatever fits into one bin still does; the mapped total
    over the mapped capacity bounds the bins. Used are the identity, the rounding functions
    u_k, and for each threshold e the two that ignore lengths below e and raise those above
    capacity - e, or count how many e are lost beside lengths above a half.
    """
    if not len(lengths):
        return 0
    x, n, c = lengths.astype(np.int64), counts.astype(np.int64), capacity
    best = -(-int((x * n).sum()) // c)
    for k in range(1, 65):
        scaled = (k + 1) * x
        value = np.where(scaled % c == 0, x * k, scaled // c * c)
        best = max(best, -(-int((value * n).sum()) // (k * c)))
    for e in range(1, c // 2 + 1):
        value = np.where(x > c - e, c, np.where(x >= e, x, 0))
        best = max(best, -(-int((value * n).sum()) // c))
        whole = c // e
        value = np.where(2 * x > c, whole - (c - x) // e, np.where(x >= e, 1, 0))
        best = max(best, -(-int((value * n).sum()) // whole))
    return best


def pack_lengths(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """(piece_key, sequence_id, offset) for items of (piece_key, length).

    Items of full length are sequences of their own. The others are dealt into groups by a
    hash of their keys, and every group is packed by best-fit decreasing and compared with
    its lower bound. Groups above their bound give back all bins with room, groups that meet
    it the emptiest one; these items are dealt anew among groups and packed again, as long as
    that saves bins and the bound of all items is not met, ``rounds`` times at most.
    """
    full = items.where(F.col("length") >= capacity).select(
        "piece_key", (-F.col("piece_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pool = items.where(F.col("length") < capacity).select("piece_key", "length")
    # One row per length, fewer than the capacity.
    sizes = pool.groupBy("length").count().collect()
    lengths = np.array([r["length"] for r in sizes], np.int64)
    counts = np.array([r["count"] for r in sizes], np.int64)
    least, n, bins, kept = bin_bound(lengths, counts, capacity), int(counts.sum()), None, [full]
    for turn in range(rounds):
        packed = staged(_pack_groups(pool, n, turn, capacity, group), "packed")
        now = packed.agg(
            F.count_if(F.col("offset") == 0).alias("bins"),
            F.count_if((F.col("offset") == 0) & F.col("back")).alias("back_bins"),
            F.count_if("back").alias("back"),
        ).first()
        if bins is not None and now["bins"] >= bins:
            break  # the packing before is as good
        if last := bins is not None:
            kept[-1] = kept[-1].where("NOT back")
        kept.append(packed)
        total = now["bins"] if not last else total - bins + now["bins"]
        if total <= least or not now["back"]:
            break
        pool, n, bins = packed.where("back"), now["back"], now["back_bins"]
    return reduce(DataFrame.unionByName, [k.select("piece_key", "sequence_id", "offset") for k in kept])


def _pack_groups(pool: DataFrame, n: int, turn: int, capacity: int, group: int) -> DataFrame:
    groups = max(1, -(-n // group))
    dealt = pool.select(
        "piece_key", "length", F.pmod(F.xxhash64("piece_key", F.lit(turn)), F.lit(groups)).alias("part")
    )

    def pack(items: pa.Table) -> pa.Table:
        items = items.sort_by([("length", "descending"), ("piece_key", "ascending")])
        lengths = items.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths.tolist(), capacity)
        room, bins = np.array(left), np.array(bins, np.int64)
        values, counts = np.unique(lengths, return_counts=True)
        if len(room) > bin_bound(values, counts, capacity):
            back = room > 0
        else:
            back = (np.arange(len(room)) == room.argmax()) & (room > 0)
        part = items.column("part")[0].as_py()
        sequence = (turn + 1 << 56) + (part << 24) + bins
        return pa.table(
            {
                "piece_key": items.column("piece_key"),
                "length": items.column("length"),
                "sequence_id": pa.array(sequence, pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "back": pa.array(back[bins]),
            }
        )

    return dealt.groupBy("part").applyInArrow(
        pack, "piece_key long, length int, sequence_id long, offset long, back boolean"
    )


def packed_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence_id and offset. ``pieces`` is read more than once: give a
    stored table. Other columns come along."""
    places = pack_lengths(pieces.select("piece_key", "length"), capacity, group)
    return pieces.join(places, "piece_key")


def packed_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, cached: int = KEPT, keep: bool = True
) -> DataFrame:
    """Pieces of all documents with crc32 of their ids and their places; the ids themselves
    are left out, see :func:`token_pieces` and :func:`packed_pieces` to keep them."""
    pieces = token_pieces(docs, tokenizer, capacity, cached=cached, keep=keep).select(
        "piece_key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    packed = packed_pieces(staged(pieces, "pieces"), capacity, group)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


@query("op3_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
