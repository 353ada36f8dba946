"""Trigram postings.

Long form: one row (gram, doc_id) per distinct pair. It is the working form for search,
merge and removal because no row ever depends on how common a gram is. The list form cuts
each posting into segments of bounded length, so that a gram found in most documents is
spread over many rows instead of one huge array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trigrams
from .sizing import broadcast_if_small

_FLUSH = 1 << 17  # gram rows per output batch
_BLOCK = 1 << 20  # rows that a task groups or orders at a time
_PART = 1 << 17  # characters of a text that are cut into grams at a time

SEGMENTS = 64


def _gram_strings(keys: np.ndarray) -> pa.Array:
    """Packed grams (three 21-bit code points) to strings, each distinct gram built once."""
    uniq, where = np.unique(keys, return_inverse=True)
    mask = (1 << 21) - 1
    points = np.stack([(uniq >> 42) & mask, (uniq >> 21) & mask, uniq & mask], axis=1).astype("<u4")
    widths = 3 + sum(np.count_nonzero(points >= least, axis=1) for least in (0x80, 0x800, 0x10000))
    ends = np.append(0, np.cumsum(widths)).astype("int32")
    flat = points.tobytes().decode("utf-32-le").encode()
    names = pa.StringArray.from_buffers(len(uniq), pa.py_buffer(ends), pa.py_buffer(flat))
    return names.take(pa.array(where.astype("int32")))


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order, by one sort (``np.unique`` hashes them first)."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _packed_grams(text: str) -> np.ndarray:
    """Distinct grams of a text, packed and in order. A long text is cut in parts, so that the
    arrays of a part and not of the text are held besides it."""
    found, parts, held = np.empty(0, dtype="int64"), [], 0
    for at in range(0, len(text) - 2, _PART):
        points = np.frombuffer(text[at : at + _PART + 2].encode("utf-32-le"), dtype="<u4").astype("int64")
        parts.append(_in_order((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]))
        held += len(parts[-1])
        if held >= _PART + len(found):
            found, parts, held = _in_order(np.concatenate([found, *parts])), [], 0
    if len(parts) == 1 and not len(found):
        return parts[0]
    return _in_order(np.concatenate([found, *parts]))


def gram_sets(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., grams): the distinct grams of every document; documents without any drop out.

    Text is lower-cased in the JVM (the same ``lower`` that the search recheck uses) and cut
    in Arrow batches with array arithmetic. Nothing is shuffled.
    """
    lowered = docs.select(*keys, F.lower(F.col(text)).alias("__text"))
    schema = docs.select(*keys).schema.add("grams", T.ArrayType(T.StringType()))
    n_keys = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            rows: list[int] = []
            held = 0

            def flush():
                ends = np.cumsum([0, *map(len, found)]).astype("int32")
                lists = pa.ListArray.from_arrays(ends, _gram_strings(np.concatenate(found)))
                index = pa.array(rows, pa.int32())
                columns = [batch.column(i).take(index) for i in range(n_keys)]
                return pa.RecordBatch.from_arrays([*columns, lists], [*keys, "grams"])

            for row, value in enumerate(batch.column(n_keys)):  # a text at a time becomes a string
                grams = _packed_grams(value.as_py() or "")
                if len(grams):
                    found.append(grams)
                    rows.append(row)
                    held += len(grams)
                if held >= _FLUSH:
                    yield flush()
                    found, rows, held = [], [], 0
            if held:
                yield flush()

    return lowered.mapInArrow(cut, schema)


def gram_pairs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Distinct (keys..., gram) of every document, in long form."""
    return gram_sets(docs, text, keys).select(*keys, F.explode("grams").alias("gram"))


def ordered_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, doc_id) of every document as :func:`gram_pairs` has them, in blocks of about a
    million rows in order of (gram, doc_id). A stored table of them keeps few grams to a page,
    and no task has to sort all its rows."""
    lowered = docs.select("doc_id", F.lower(F.col(text)).alias("__text"))
    schema = T.StructType([T.StructField("gram", T.StringType()), docs.schema["doc_id"]])

    def ordered(ids: list[pa.Scalar], found: list[np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        values = pa.array([i.as_py() for i in ids], kind)
        rows = pc.sort_indices(values).to_pylist()
        keys = np.concatenate([found[i] for i in rows])
        of = np.repeat(np.array(rows, "int32"), [len(found[i]) for i in rows])
        order = np.argsort(keys, kind="stable")
        for at in range(0, len(order), _FLUSH):
            part = order[at : at + _FLUSH]
            yield pa.RecordBatch.from_arrays([_gram_strings(keys[part]), values.take(pa.array(of[part]))], ["gram", "doc_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                grams = _packed_grams(value.as_py() or "")
                if len(grams):
                    ids.append(doc_id)
                    found.append(grams)
                    held += len(grams)
                if held >= _BLOCK:
                    yield from ordered(ids, found, kind)
                    ids, found, held = [], [], 0
        if held:
            yield from ordered(ids, found, kind)

    return lowered.mapInArrow(cut, schema)


def doc_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """Forward form: each document with its array of grams (short texts)."""
    return docs.select("doc_id", F.array_sort(trigrams(text)).alias("grams"))


def gram_counts(pairs: DataFrame) -> DataFrame:
    """Number of documents per gram."""
    return pairs.groupBy("gram").agg(F.count("*").alias("n_docs"))


def posting_lists(pairs: DataFrame, n_segments: int = SEGMENTS) -> DataFrame:
    """(gram, segment, doc_ids sorted, n_docs): postings cut into a fixed number of segments
    by a mixed residue of the document id, so that keys stay as they are when the table grows
    and ids with a stride spread evenly. Take more segments for more documents: a common
    gram's array has about documents / segments ids."""
    mixed = F.pmod(F.col("doc_id"), F.lit(1_000_003)) * 40_503
    placed = pairs.withColumn("segment", F.pmod(F.floor(mixed / 256), F.lit(n_segments)))
    return value_lists(placed, ["gram", "segment"], "doc_id", "doc_ids").withColumn("n_docs", F.size("doc_ids").cast("long"))


def value_lists(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys..., name): the distinct values of each key in order, nulls left out.

    Every task groups blocks of rows with Arrow, so that lists and not rows are shuffled.
    """
    chosen = rows.select(*keys, value)
    schema = T.StructType([*chosen.select(*keys).schema.fields, T.StructField(name, T.ArrayType(chosen.schema[value].dataType))])

    def lists(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(value, "list")])
        columns = [*(grouped.column(k) for k in keys), grouped.column(f"{value}_list")]
        yield from pa.table(columns, names=schema.names).to_batches(max_chunksize=_FLUSH)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _BLOCK:
                yield from lists(held)
                held, n = [], 0
        if n:
            yield from lists(held)

    every = F.flatten(F.collect_list(name))
    folded = chosen.mapInArrow(fold, schema).groupBy(*keys)
    return folded.agg(F.sort_array(F.array_distinct(F.array_compact(every))).alias(name))


def doc_runs(pairs: DataFrame) -> DataFrame:
    """(doc_id, grams): rows of a document that lie together as one row. A document has as many
    rows as places where its pairs lie; in postings fresh from the texts that is one or two."""
    chosen = pairs.select("doc_id", "gram")
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("grams", T.ArrayType(T.StringType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, grams = batch.column(0), batch.column(1)
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            if 4 * len(first) > n:  # not by document: put in order what lies in this batch
                order = pa.array(np.argsort(codes, kind="stable"))
                ids, grams, codes = ids.take(order), grams.take(order), codes[order.to_numpy()]
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            ends = pa.array(np.append(first, n).astype("int32"))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.ListArray.from_arrays(ends, grams)], schema.names)

    return chosen.mapInArrow(fold, schema)


def gram_total(pairs: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("gram") if approximate else F.countDistinct("gram")
    return pairs.agg(count.alias("trigrams"))


def matching_docs(pairs: DataFrame, grams: list[str]) -> DataFrame:
    """Documents that hold every one of the given grams (a set intersection).

    Written as a count per document: the gram filter reaches the scan of a stored posting
    table, and partial counts are combined before the shuffle.
    """
    wanted = sorted(set(grams))
    return (
        pairs.where(F.col("gram").isin(*wanted))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == len(wanted))
        .select("doc_id")
    )


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of two long-form postings (gram, doc_id). The grams of a document are shuffled
    as one array for each run of its rows, and made distinct inside it."""
    runs = doc_runs(old.unionByName(new))
    merged = runs.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    return merged.select("doc_id", F.explode("grams").alias("gram")).select(*old.columns)


def remove_docs(pairs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings without the given documents; grams left without a document are gone."""
    return pairs.join(broadcast_if_small(doc_ids.select("doc_id").distinct()), "doc_id", "left_anti")


def stale_grams(old_sets: DataFrame, new_sets: DataFrame) -> DataFrame:
    """(doc_id, gram) pairs that a document had before and has no longer, from the gram sets
    of its old and new text (no new set: the document is gone)."""
    new = new_sets.select("doc_id", F.col("grams").alias("__now"))
    lost = F.when(F.col("__now").isNull(), F.col("grams")).otherwise(F.array_except("grams", "__now"))
    return old_sets.join(new, "doc_id", "left").select("doc_id", F.explode(lost).alias("gram"))


def empty_postings(pairs: DataFrame) -> DataFrame:
    """Postings of an empty index, for a full wipe by overwrite."""
    return pairs.where(F.lit(False))
