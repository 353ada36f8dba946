"""Bitmap postings: documents of a gram as bits over dense document numbers.

Documents are numbered 1, 2, ... in order of their ids, and numbers fall into buckets of
32 768, as Spark's bitmap functions cut them. A gram's documents in a bucket are a bitmap of
4 KB where they are many, and a sorted list of places where they are few, so neither grows
with how common a gram is. Intersections work on whole buckets with ``bitmap_and_agg``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import trigrams
from .postings import doc_runs, value_lists
from .search import candidate_lines, usable_queries
from .sizing import broadcast_if_small, staged

DENSE = 256  # places of a bucket from which a bitmap takes the place of the list
BUCKET = 1 << 15


def document_numbers(doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number): the distinct keys numbered from 1 in their order.

    Ids are dealt by range and numbered inside their range; the ranges' sizes, a row for
    each, say where a range begins. Null ids have no number.
    """
    ids = doc_ids.where(F.col(key).isNotNull()).select(key).distinct()
    ranged = staged(ids.repartitionByRange(key).select(key, F.spark_partition_id().alias("range")), "ranges")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(staged(sizes.select("range", before.alias("before")), "range-starts"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return ranged.join(starts, "range").select(key, (F.col("before") + place).alias("number"))


class BitmapIndex:
    """Tables below a folder that all executors share: ``numbers`` (doc_id, number), ``bits``
    (gram, bucket, n_docs, bits) and ``lists`` (gram, bucket, n_docs, places), the last two
    in order of grams inside their files, so that a search reads the row groups of its grams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def numbers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/numbers")

    def bits(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/bits")

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def sizes(self) -> DataFrame:
        """(gram, bucket, n_docs), counted on what is stored: set bits, or places."""
        bits = self.bits().select("gram", "bucket", F.bitmap_count("bits").alias("n_docs"))
        return bits.unionByName(self.lists().select("gram", "bucket", F.size("places").cast("long").alias("n_docs")))

    def candidates(self, query_grams: DataFrame) -> DataFrame:
        """(query_id, doc_id) of the documents that have all grams of a query (query_id, gram).

        Only buckets in which every gram of a query occurs are read beyond their keys; their
        lists become bitmaps, and one bitmap a query and bucket is left of the intersection.
        """
        asked = query_grams.select("query_id", "gram").distinct()
        need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        asked = broadcast_if_small(staged(asked.join(broadcast_if_small(need), "query_id"), "asked-grams"))
        keys = self.bits().select("gram", "bucket").unionByName(self.lists().select("gram", "bucket"))
        whole = keys.join(asked, "gram").groupBy("query_id", "bucket").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need"))
        whole = whole.where("have = need").select("query_id", "bucket", "need")
        whole = broadcast_if_small(staged(whole, "whole-buckets"))
        asked = asked.drop("need")
        dense = self.bits().join(asked, "gram").join(whole, ["query_id", "bucket"]).select("query_id", "bucket", "need", "bits")
        few = self.lists().join(asked, "gram").join(whole, ["query_id", "bucket"])
        few = few.select("query_id", "gram", "bucket", "need", F.explode("places").alias("place"))
        few = few.groupBy("query_id", "gram", "bucket", "need").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")).drop("gram")
        both = dense.unionByName(few).groupBy("query_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
        numbers = _set_bits(both.where(F.bitmap_count("bits") > 0))
        return staged(numbers, "candidate-numbers").join(self.numbers(), "number").select("query_id", "doc_id")

    def search(self, files: DataFrame, queries: DataFrame) -> DataFrame:
        """:func:`search.search_many` through the index: every line hit of every query
        (query_id, query) in ``files``; documents that are gone from ``files`` have none."""
        usable = usable_queries(queries)
        grams = usable.select("query_id", F.explode(trigrams("needle")).alias("gram"))
        return candidate_lines(files, self.candidates(grams), usable)


def build_bitmaps(pairs: DataFrame, folder: str, *, dense: int = DENSE) -> BitmapIndex:
    """Store long-form postings (gram, doc_id) as bitmaps in a new folder.

    Numbers meet the runs of a document's grams (:func:`postings.doc_runs`), not each pair.
    Places of a gram and bucket meet once, combined on the map side and at most BUCKET of them; where they are ``dense`` or more they become a bitmap. ``pairs`` is read twice, so
    pass a stored table; rows that repeat count once.
    """
    index = BitmapIndex(pairs.sparkSession, folder)
    document_numbers(pairs).write.mode("error").parquet(f"{index.folder}/numbers")
    numbered = doc_runs(pairs).join(broadcast_if_small(index.numbers()), "doc_id").select(
        F.explode("grams").alias("gram"), F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").cast("int").alias("place")
    )
    lists = value_lists(numbered, ["gram", "bucket"], "place", "places")
    lists = staged(lists.withColumn("n_docs", F.size("places").cast("long")), "gram-places")
    few = lists.where(F.col("n_docs") < dense).select("gram", "bucket", "n_docs", "places")
    many = lists.where(F.col("n_docs") >= dense).select("gram", "bucket", "n_docs", "places")
    for name, rows in (("lists", few), ("bits", _as_bits(many))):
        rows.sortWithinPartitions("gram", "bucket").write.mode("error").parquet(f"{index.folder}/{name}")
    return index


def _as_bits(rows: DataFrame) -> DataFrame:
    """(gram, bucket, n_docs, places) with bitmaps, as ``bitmap_construct_agg`` makes them, in place
    of the places; a row each, so nothing is shuffled again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for places in batch.column("places"):
                bits = np.zeros(BUCKET, np.uint8)
                bits[places.values.to_numpy()] = 1
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            columns = [batch.column(c) for c in ("gram", "bucket", "n_docs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["gram", "bucket", "n_docs", "bits"])

    return rows.mapInArrow(pack, "gram string, bucket long, n_docs long, bits binary")


def _set_bits(rows: DataFrame) -> DataFrame:
    """(query_id, number) of each bit set in (query_id, bucket, bits)."""
    id_field = rows.schema["query_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = T.StructType([id_field, T.StructField("number", T.LongType())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            for i, raw in enumerate(batch.column("bits")):
                places = np.flatnonzero(np.unpackbits(np.frombuffer(raw.as_buffer(), np.uint8), bitorder="little"))
                ids = pa.array([batch.column("query_id")[i].as_py()], id_type).take(pa.array(np.zeros(len(places), np.int32)))
                # Buckets and numbers count from 1, places from 0.
                yield pa.RecordBatch.from_arrays([ids, pa.array((buckets[i] - 1) * BUCKET + places + 1)], ["query_id", "number"])

    return rows.select("query_id", "bucket", "bits").mapInArrow(expand, schema)
