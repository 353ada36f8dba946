"""Exact substring dedup with suffix arrays of shards that hold all copies of a string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from .registry import query, table
from .suffix_array import common_prefixes, suffix_array
from .words import _BASE, mix, powers
from .worker import row_slices, shared, text_buffers

LENGTH = 100
GRAM = 24  # bytes hashed at each position
SHARD_BYTES = 768 << 10
GROUP = 2048  # contexts of one anchor in one shard
_CONTEXT = 2 * LENGTH - GRAM  # bytes a context has at most
_PIECE = 1 << 20
_SLICE = 1 << 21
_LAST = (1 << 63) - 1


class _Rolling:
    def __init__(self, n: int):
        rng = np.random.default_rng(100)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = powers(np.uint64(_BASE), n)
        self.down = powers(np.uint64(pow(_BASE, -1, 1 << 64)), n)


def anchors(data: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, context, start, count) of the anchors of one text.

    The anchor of a window of ``length`` bytes is its leftmost gram of smallest hash. Windows
    with one anchor start at ``count`` places in a row; their bytes are the anchor's context,
    from ``start`` on. Equal windows have equal anchors at equal distances, so equal windows
    have contexts with equal ``hash``. ``context`` is a hash of the context.
    """
    grams = length - GRAM + 1
    t = shared("rolling hashes", lambda: _Rolling(_PIECE + 4 * LENGTH))
    for a in range(0, max(len(data) - length + 1, 0), _PIECE):
        part = data[a : a + _PIECE + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(t.values[part] * t.up[:n], out=sums[1:])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * t.down[: n - GRAM + 1])
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= grams:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if grams > reach:
            least = np.minimum(least[: -(grams - reach)], least[grams - reach :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at))
        shape = ((last - first) << 8 | (at[first] - first)).astype(np.uint64)
        context = mix((sums[last - 1 + length] - sums[first]) * t.down[first] + mix(shape))
        yield h[at[first]], context, first + a, last - first


_OCCURRENCE = "doc long, twin long, hash long, context long, place long, again boolean"


def _occurrences(rows: DataFrame) -> DataFrame:
    """Anchors of all texts: place is start * 256 + count, and ``again`` marks a context that
    its document has before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                data, offsets = text_buffers(batch.column("text"))
                owner, found = [], []
                for i in range(batch.num_rows):
                    for hashes, context, start, count in anchors(data[offsets[i] : offsets[i + 1]]):
                        owner.append(np.full(len(hashes), i))
                        found.append((hashes, context, start << 8 | count))
                if not owner:
                    continue
                owner = np.concatenate(owner)
                hashes, context, place = (np.concatenate(x) for x in zip(*found))
                key = mix(hashes ^ mix(context + owner.astype(np.uint64)))
                again = np.ones(len(owner), bool)
                again[np.unique(key, return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(pa.array(owner)),
                        batch.column("twin").take(pa.array(owner)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array(place),
                        pa.array(again),
                    ],
                    ["doc", "twin", "hash", "context", "place", "again"],
                )

    return rows.select("doc", "twin", "text").mapInArrow(find, _OCCURRENCE)


def repeated_windows(starts: np.ndarray, doc: np.ndarray, twin: np.ndarray, texts: list[bytes], length: int = LENGTH):
    """Of contexts in ascending (doc, twin, start): for each window its context, its start in
    the document, and whether an earlier equal one is in the shard.

    A window is repeated if the shard has an equal one in a smaller document, or earlier in
    its own; texts that share a doc do not count against each other.
    """
    joined = b"\x00".join(texts) + b"\x00"
    # Bytes of texts are moved up by one, so that the separator is smaller than all.
    data = np.frombuffer(joined, np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data[begin[1:] - 1] = 0
    data[-1] = 0
    order = suffix_array(data)
    shares = common_prefixes(data, order)
    counts = sizes - length + 1
    context = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = begin[context] + offset
    run = np.zeros(len(data), np.int64)
    run[order] = np.cumsum(shares[order] < length)
    # Windows of a run in ascending position, which is ascending (doc, twin, start).
    by_run = np.lexsort((window, run[window]))
    r = run[window][by_run]
    head = np.concatenate([[True], r[1:] != r[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
    c = context[by_run]
    same_row = np.zeros(len(r), bool)
    same_row[1:] = ~head[1:] & (doc[c[1:]] == doc[c[:-1]]) & (twin[c[1:]] == twin[c[:-1]])
    repeated = np.zeros(len(r), bool)
    repeated[by_run] = (doc[c] != doc[c[first]]) | same_row
    return context, starts[context] + offset, repeated


def _intervals(context: np.ndarray, start: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows of one context: context, first start and count."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (context[at[1:]] != context[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)])
    first = np.flatnonzero(new)
    return context[at[first]], start[at[first]], np.diff(np.append(first, len(at)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, twin, spans) of the texts that have repeated strings: arrays of (place), start *
    256 + count of windows in a row of which each is repeated."""
    keyed = _keyed(docs)
    found = _occurrences(keyed)
    repeated = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    met = staged(found.join(repeated, "hash"), "met")

    contexts = met.groupBy("hash", "context").agg(F.min("doc").alias("first"))
    contexts = staged(contexts, "contexts")
    several = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    contexts = contexts.join(several, "hash", "left")
    placed = staged(met.join(contexts, ["hash", "context"]), "occurrences")
    copies = placed.where("again OR doc <> first").select("doc", "twin", "place")

    # Contexts that differ around an anchor: all of an anchor in a shard, or, where there are
    # very many, dealt over several.
    wanted = placed.where("n IS NOT NULL AND NOT again AND doc = first")
    total = wanted.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-total * _CONTEXT // SHARD_BYTES))
    parts = F.ceil(F.col("n") / GROUP)
    part = F.when(parts > 1, F.pmod("context", parts))
    wanted = wanted.select(
        "doc",
        "twin",
        "place",
        part.isNotNull().alias("open"),
        F.pmod(F.xxhash64("hash", F.coalesce(part, F.lit(0))), F.lit(shards)).alias("shard"),
    )
    texts = _contexts(keyed, wanted)
    judged = staged(texts.groupBy("shard").applyInArrow(_judge, _JUDGED), "judged")
    spans = copies.unionByName(judged.where("digest IS NULL").select("doc", "twin", "place"))
    spans = spans.unionByName(_across_shards(judged.where("digest IS NOT NULL")))
    return spans.groupBy("doc", "twin").agg(F.collect_list("place").alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, twin, text): null ids come last, and ``twin`` tells texts apart that share an id."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    hashed = rows.select("doc", F.xxhash64("text").alias("text_hash"))
    twins = hashed.groupBy("doc").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
    twins = broadcast_if_small(staged(twins.where("lo <> hi").select("doc", F.lit(True).alias("several")), "twins"))
    rows = rows.join(twins, "doc", "left")
    return rows.select("doc", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("twin"), "text")


_CUT = "shard long, open boolean, doc long, twin long, place long, bytes binary"


def _contexts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts, cut from their texts; of repeated rows once."""
    lists = wanted.distinct().groupBy("doc", "twin").agg(F.collect_list(F.struct("shard", "open", "place")).alias("wanted"))
    joined = keyed.join(lists, ["doc", "twin"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                lists = batch.column("wanted")
                items = lists.flatten()
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
                data, offsets = text_buffers(batch.column("text"))
                place = items.field("place").to_numpy()
                a = offsets[owner] + (place >> 8)
                b = a + (place & 255) + LENGTH - 1
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        items.field("shard"),
                        items.field("open"),
                        batch.column("doc").take(pa.array(owner)),
                        batch.column("twin").take(pa.array(owner)),
                        items.field("place"),
                        pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist())], pa.binary()),
                    ],
                    ["shard", "open", "doc", "twin", "place", "bytes"],
                )

    return joined.select("doc", "twin", "text", "wanted").mapInArrow(cut, _CUT)


_JUDGED = "doc long, twin long, place long, digest binary"


def _judge(rows: pa.Table) -> pa.Table:
    """Repeated windows of a shard as runs; windows of open groups that have no earlier copy in
    the shard as rows with a digest of their bytes."""
    rows = rows.group_by(["doc", "twin", "place", "open"], use_threads=False).aggregate([("bytes", "min")])
    rows = rows.sort_by([("doc", "ascending"), ("twin", "ascending"), ("place", "ascending")])
    doc, twin, place = (rows.column(c).to_numpy() for c in ("doc", "twin", "place"))
    texts = rows.column("bytes_min").to_pylist()
    context, start, repeated = repeated_windows(place >> 8, doc, twin, texts)
    c, first, count = _intervals(context, start, repeated)
    opened = rows.column("open").to_numpy(zero_copy_only=False)
    left = np.flatnonzero(opened[context] & ~repeated)
    lc, ls = context[left], start[left]
    digests = [
        hashlib.blake2b(texts[i][s : s + LENGTH], digest_size=16).digest()
        for i, s in zip(lc.tolist(), (ls - (place[lc] >> 8)).tolist())
    ]
    return pa.table(
        {
            "doc": np.concatenate([doc[c], doc[lc]]),
            "twin": np.concatenate([twin[c], twin[lc]]),
            "place": np.concatenate([first << 8 | count, ls << 8 | 1]),
            "digest": pa.array([None] * len(c) + digests, pa.binary()),
        }
    )


def _across_shards(windows: DataFrame) -> DataFrame:
    """Of windows that are the first of their shard those that have an earlier copy in another."""
    lowest = windows.groupBy("digest").agg(F.min("doc").alias("first_doc"))
    own = windows.groupBy("digest", "doc", "twin").agg(F.min("place").alias("first_place"))
    marked = windows.join(lowest, "digest").join(own, ["digest", "doc", "twin"])
    return marked.where("doc <> first_doc OR place <> first_place").select("doc", "twin", "place")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: UTF-8 bytes of its text, how
    many are removed in how many maximal runs, and the bytes left (binary).

    A byte is removed if a string of LENGTH bytes that covers it starts earlier too, in a
    document with a smaller doc_id or before in its own; strings are judged on the input.
    A null text is empty and a null doc_id counts as the largest. Rows that repeat a doc_id do
    not remove each other's strings, but are all compared with smaller ids. Other columns are
    not read.

    Strings are brought together by anchors chosen from their content. Contexts of anchors
    that are equal in full are settled by a count that combines on the map side. Only those
    that differ go into shards, whose suffix arrays are built by induced sorting and whose
    common prefixes tell equal strings. An anchor with very many contexts is dealt over
    several shards, of which only first windows are compared further.
    """
    spans = staged(repeated_spans(docs), "spans")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twins = spans.where("twin <> 0").select("doc", F.lit(True).alias("several")).distinct()
    rows = rows.join(twins, "doc", "left").withColumn("twin", F.when(F.col("several"), F.xxhash64("text")).otherwise(0))
    rows = rows.join(spans, ["doc", "twin"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                data, offsets = text_buffers(batch.column("text"))
                removed, runs, kept = [], [], []
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    places = batch.column("spans")[i]
                    if not places.is_valid:
                        removed.append(0)
                        runs.append(0)
                        kept.append(raw.tobytes())
                        continue
                    place = places.values.to_numpy()
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, place >> 8, 1)
                    np.add.at(edge, (place >> 8) + (place & 255) + LENGTH - 1, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    removed.append(int(covered.sum()))
                    runs.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
                    kept.append(raw[~covered].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.array(removed, pa.int64()),
                        pa.array(runs, pa.int64()),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op7_suffixes")
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
