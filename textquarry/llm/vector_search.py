"""Exact top-k search over vector-approximation files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from ..session import shared_folder
from .hard_negatives import PASS_BYTES, in_passes
from .registry import query, table

BITS = 8  # a byte a component
CHUNK = 4096
QUERY_BLOCK = 512
READ_FIRST = 4  # times the results wanted: candidates of a query whose exact vectors are read at first
QUERY_STEP = 50
K = 5
SCALE = 256


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component. Rows whose key, vector or a component is
    null or not finite take no part, and neither do empty vectors."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    return rows.where(F.coalesce(usable, F.lit(False))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


class _Cells:
    """A chunk's cells: a byte per component that counts equal widths from the smallest value of
    its dimension in the chunk on."""

    def __init__(self, cells: np.ndarray, lo: np.ndarray, width: np.ndarray):
        self.low = (lo + cells * width).astype(np.float64)
        self.high = self.low + (width - 1)

    @staticmethod
    def of(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, smallest components and widths of 2**bits cells a dimension."""
        lo = v.min(axis=0)
        width = np.maximum(-(-(v.max(axis=0) - lo + 1) // (1 << bits)), 1)
        return ((v - lo) // width).astype(np.uint8), lo, width

    def at_least(self, q: np.ndarray) -> np.ndarray:
        """Lower bounds of inner products, a row per query: at each component the low or high end
        of the cell, whichever the sign of the query's component makes smaller."""
        up, down = _signs(q)
        return up @ self.low.T + down @ self.high.T

    def at_most(self, q: np.ndarray) -> np.ndarray:
        up, down = _signs(q)
        return up @ self.high.T + down @ self.low.T


def _signs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)


def _cell_chunks(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """The approximation file: ids, cells and their edges of up to ``size`` rows of one vector
    length. Exact components are not in it."""
    names = ("ids", "cells", "lo", "width")
    schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in names)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                for a in range(0, same.num_rows, size):
                    part = same.slice(a, size)
                    ids, v = _arrays(part.column("id"), part.column("v"), int(dim))
                    held = (ids.astype("<i8"), *_Cells.of(v, bits))
                    columns = [pa.array([x.tobytes()], pa.binary()) for x in held]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns], schema=schema)

    return rows.select("id", "v").mapInArrow(pack, "dim int, ids binary, cells binary, lo binary, width binary")


def _arrays(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scan(chunks: DataFrame, queries: DataFrame, scan, schema: str, block: int, pass_bytes: int) -> DataFrame:
    """``scan(asked, q, ids, cells)`` for every chunk beside every block of queries of its vector
    length: (columns of ``schema``) as arrays. Each pass reads the chunks where they are, beside
    a broadcast group of blocks of a bounded size."""
    spark = chunks.sparkSession
    folder = shared_folder(spark, f"vector-scan-{uuid.uuid4().hex[:12]}")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, asked = batch.column("dim")[i].as_py(), batch.column("anchors")[i].values
                _, q = _arrays(asked.field("id"), asked.field("v"), dim)
                ids, lo, width = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "lo", "width"))
                cells = np.frombuffer(batch.column("cells")[i].as_buffer(), np.uint8).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in scan(asked, q, ids, _Cells(cells, lo, width))], names)

    spark.createDataFrame([], schema).write.parquet(folder)
    for group in in_passes(queries, block, pass_bytes):
        beside = chunks.join(F.broadcast(group), "dim").select("dim", "anchors", "ids", "cells", "lo", "width")
        beside.mapInArrow(run, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def exact_top_k(
    base: DataFrame,
    queries: DataFrame,
    k: int = K,
    *,
    bits: int = BITS,
    chunk: int = CHUNK,
    query_block: int = QUERY_BLOCK,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query (id, v) the k rows of ``base`` (id, v)
    with the highest inner products, the query's own id left out, ties to the smaller id.

    ``v`` are arrays of integers; vectors of different lengths have no inner product, so a
    query is answered by rows of its own length. Equal vectors are searched as one: of a group
    of copies the k + 1 smallest ids can be results, and equal queries share one search. Rows
    that repeat an id and vector count once.

    Base vectors are written a second time as a file of cells, one byte a component. A first
    scan of the cells finds for each query a score that k vectors certainly reach, a second
    one the candidates whose upper bound is not below it. Exact vectors are then read for
    candidates alone, in order of their bounds: the first few of each query give a score that
    k results reach, and of the rest only those are read whose bound is not below that.
    """
    copies = k + 1
    by_vector = Window.partitionBy("v").orderBy("id")
    members = base.select("id", "v").withColumn("place", F.dense_rank().over(by_vector))
    members = staged(members.where(F.col("place") <= copies).distinct(), "vector-members")
    heads = members.where("place = 1").select("id", "v")
    chunks = staged(_cell_chunks(heads, chunk, bits), "vector-cells")
    asked = queries.select(F.col("id").alias("query_id"), "v").distinct()
    searches = staged(asked.groupBy("v").agg(F.min("query_id").alias("id")), "vector-queries").select("id", "v")

    def reach(asked: pa.StructArray, q: np.ndarray, ids: np.ndarray, cells: _Cells) -> tuple[np.ndarray, ...]:
        """The ``copies`` highest lower bounds that a chunk has for each query."""
        low = cells.at_least(q)
        m = min(copies, low.shape[1])
        best = -np.partition(-low, m - 1, axis=1)[:, :m]
        own = asked.field("id").to_numpy(zero_copy_only=False)
        return np.repeat(own, m), np.floor(best.reshape(-1)).astype(np.int64)

    lows = _scan(chunks, searches, reach, "id long, low long", query_block, pass_bytes)
    nth = Window.partitionBy("id").orderBy(F.desc("low"))
    least = lows.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= copies).groupBy("id").agg(
        F.when(F.count(F.lit(1)) == copies, F.min("low")).cast("double").alias("least")
    )

    def near(asked: pa.StructArray, q: np.ndarray, ids: np.ndarray, cells: _Cells) -> tuple[np.ndarray, ...]:
        """Rows whose upper bound is not below what is certain for the query."""
        own, sure = (asked.field(c) for c in ("id", "least"))
        high = cells.at_most(q)
        row, column = np.nonzero(high >= sure.fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None])
        return own.to_numpy(zero_copy_only=False)[row], ids[column], np.ceil(high[row, column]).astype(np.int64)

    bounded = searches.join(least, "id").select("id", "v", "least")
    candidates = _scan(chunks, bounded, near, "id long, head long, high long", query_block, pass_bytes)
    nth = Window.partitionBy("id").orderBy(F.desc("high"), "head")
    first = candidates.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= READ_FIRST * copies)
    first = _exact_scores(first.select("id", "head"), heads, searches)
    nth = Window.partitionBy("id").orderBy(F.desc("score"), "head")
    sure = first.withColumn("n", F.row_number().over(nth)).where(F.col("n") == copies).select("id", F.col("score").alias("sure"))
    rest = candidates.join(first.select("id", "head"), ["id", "head"], "left_anti").join(sure, "id", "left")
    rest = rest.where(F.col("sure").isNull() | (F.col("high") >= F.col("sure"))).select("id", "head")
    hits = first.unionByName(_exact_scores(rest, heads, searches))
    hits = hits.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= copies).drop("n")

    head_of = members.where("place = 1").select("v", F.col("id").alias("head"))
    copies_of = members.join(head_of, "v").select("head", F.col("id").alias("vec_id"))
    groups = hits.join(copies_of, "head").select("id", "vec_id", "score")
    search_of = asked.join(searches.withColumnRenamed("id", "search"), "v").select("query_id", "search")
    results = search_of.join(groups, search_of["search"] == groups["id"]).where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(rank))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact_scores(pairs: DataFrame, heads: DataFrame, searches: DataFrame) -> DataFrame:
    """(id, head, score) of the pairs (id, head). Pairs go to the exact vectors while they
    measure small, so that of these only the wanted are moved."""
    pairs = staged(pairs, "vector-pairs")
    exact = heads.select(F.col("id").alias("head"), F.col("v").alias("exact"))
    read = exact.join(broadcast_if_small(pairs), "head").join(searches, "id")
    score = F.aggregate(F.zip_with("exact", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return staged(read.select("id", "head", score.alias("score")), "vector-scores")


@query(
    "op9_vector_search",
    f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % {QUERY_STEP} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}""",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the embeddings whose vec_id is divisible by QUERY_STEP. Null ids, and vectors
    that are null, empty or hold nulls or non-finite values, take no part; an empty table
    gives no row."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("id") % QUERY_STEP == 0))
