"""A cell index for nearest-neighbour search whose results are those of the exact scan.

Vectors are dealt into cells around centroids. What is known of a cell and repo, its number of
vectors and their largest distance from the centroid, bounds the distance of all of them
from a query by the triangle inequality, so that cells which cannot hold one of the nearest
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.utils import AnalysisException

from ..functions import vectors
from .semantic import DISTANCE_DECIMALS, QUERIES_PER_PASS, matrix_of, top_of_groups, unit_rows
from .sizing import broadcast_if_small, staged

SAMPLE = 100_000  # vectors that centroids are fitted on, about
MOST_CELLS = 4096
ODD = -1  # the cell of vectors without a direction: null, zero, or of another length
_SLACK = 1e-7  # of distances, for rounding
_ROUNDS = 10


class CellIndex:
    """Tables of one index below a folder that all executors share: ``centroids`` (cell,
    centroid), ``members`` (a sub-folder for each cell) and ``cells`` (cell, repo, n, radius),
    to which every :meth:`add` appends."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def centroids(self) -> DataFrame:
        return self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.folder}/centroids")

    def members(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.folder}/columns").schema
        schema = T.StructType([*columns.fields, T.StructField("cell", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/members")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def cells(self) -> DataFrame:
        """(cell, repo, n, radius): vectors of each cell and repo, and their largest distance
        from the centroid, over all that was ever added."""
        parts = self.spark.read.schema("cell int, repo string, n long, radius double").parquet(f"{self.folder}/cells")
        return parts.groupBy("cell", "repo").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def _matrix(self) -> np.ndarray:
        """Centroids, a row per cell; there are at most MOST_CELLS."""
        rows = self.centroids().orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows], np.float64) if rows else np.zeros((0, 0))

    def add(self, chunks: DataFrame, vector: str = "vector") -> None:
        """Put more rows into the cells of their nearest centroids. ``chunks`` has the columns
        the index was built with."""
        centers = self.spark.sparkContext.broadcast(self._matrix())
        kept = [c for c in chunks.columns if c != vector]
        schema = T.StructType(
            [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), chunks.schema[vector]]
            + [chunks.schema[c] for c in kept]
        )

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centers.value
            for batch in batches:
                cell, away = _nearest_centroid(batch.column(0), c)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(away), *batch.columns], schema.names)

        rows = chunks.select(vector, *kept).mapInArrow(assign, schema)
        # A large cell spans several files; files of small cells do not mix with those of others.
        placed = rows.repartitionByRange(F.col("cell"), F.xxhash64(*kept)).sortWithinPartitions("cell")
        placed = staged(placed, "cell-members")
        placed.drop("away").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/members")
        sizes = placed.groupBy("cell", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        sizes.write.mode("append").parquet(f"{self.folder}/cells")

    def nearest(
        self, queries: DataFrame, pool: int, *, vector: str = "vector", order: Sequence[str] = ("chunk_id",), repo: str | None = None
    ) -> DataFrame:
        """The ``pool`` nearest chunks per query and repo: the rows and distances that
        :func:`semantic.nearest` finds by reading every chunk.

        For each query and repo the cells with the nearest centroids are read first, until
        they hold ``pool`` vectors. The last of the nearest found there bounds the pool: of
        the other cells only those are read whose centroid's distance, less the radius, is
        not beyond it. Queries go through in passes of QUERIES_PER_PASS.
        """
        passes = max(1, -(-queries.count() // QUERIES_PER_PASS))
        found = None
        for nth in range(passes):
            some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == nth)
            part = _Pass(self, some, pool, vector, order, repo).nearest()
            found = part if found is None else found.unionByName(part)
        return found

    def visits(self, queries: DataFrame, pool: int, *, vector: str = "vector", order: Sequence[str] = ("chunk_id",)) -> DataFrame:
        """(query_id, repo, cells, vectors, cells_read, vectors_read): what a search of one pass
        of ``queries`` reads of each repo."""
        return _Pass(self, queries, pool, vector, order, None).report()


def build_cells(
    chunks: DataFrame,
    folder: str,
    *,
    vector: str = "vector",
    order: Sequence[str] = ("chunk_id",),
    cells: int | None = None,
    sample: int = SAMPLE,
    seed: int = 7,
) -> CellIndex:
    """Index ``chunks`` (repo, order columns, vector, any others) in a new folder.

    Centroids are fitted by k-means on about ``sample`` unit vectors, taken by a hash of
    their keys; every vector is put into a cell, whatever the sample was, so the sample only
    decides how much a search can leave out. ``cells`` is the square root of the rows unless
    given, and MOST_CELLS at most. Vectors of a length other than the commonest, zero
    vectors and nulls are at distance 1 from everything and have a cell of their own.
    """
    spark = chunks.sparkSession
    lengths = chunks.groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0")
    commonest = lengths.orderBy(F.desc("n"), "dim").head(1)
    dim, total = (commonest[0]["dim"], commonest[0]["n"]) if commonest else (0, 0)
    k = min(cells or max(1, math.isqrt(total)), MOST_CELLS)
    usable = chunks.where((F.size(vector) == dim) & (vectors.norm(vector) > 0))
    if total > sample:
        usable = usable.where(F.pmod(F.xxhash64("repo", *order), F.lit(total)) < sample)
    features = staged(usable.select(vectors.normalize(vector).alias("unit")), "cell-sample")
    centers: list[np.ndarray] = []
    if features.head(1):
        points = features.select(array_to_vector("unit").alias("features"))
        centers = KMeans(k=k, seed=seed, maxIter=_ROUNDS).fit(points).clusterCenters()
    index = CellIndex(spark, folder)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").write.mode("error").parquet(f"{index.folder}/centroids")
    chunks.limit(0).write.parquet(f"{index.folder}/columns")
    index.add(chunks, vector)
    return index


def _nearest_centroid(column: pa.Array, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each vector and its distance from the centroid; ODD where it has no direction."""
    cell, away = np.full(len(column), ODD, np.int32), np.zeros(len(column))
    if not len(centers):
        return cell, away
    m, good = matrix_of(column, centers.shape[1])
    good &= (m * m).sum(axis=1) > 0
    if good.any():
        u = unit_rows(m[good])
        square = (u * u).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :] - 2 * (u @ centers.T)
        cell[good] = square.argmin(axis=1)
        away[good] = np.linalg.norm(u - centers[cell[good]], axis=1)
    return cell, away


class _Pass:
    """A search of few queries: which cells it reads, and what it finds there."""

    def __init__(self, index: CellIndex, queries: DataFrame, pool: int, vector: str, order: Sequence[str], repo: str | None):
        self.index, self.pool, self.vector, self.order = index, pool, vector, list(order)
        known = [(r["query_id"], list(r["vector"])) for r in queries.select("query_id", "vector").collect()]
        centers = index._matrix()
        dims = {len(v) for _, v in known}
        if len(dims) > 1 or (len(centers) and dims - {centers.shape[1]}):
            raise ValueError("query vectors must have the length of the indexed ones")
        self.id_field = queries.schema["query_id"]
        self.ids = [q for q, _ in known]
        raw = np.array([v for _, v in known], np.float64).reshape(len(known), dims.pop() if dims else centers.shape[1])
        self.unit = unit_rows(raw) if known else raw
        self.members = index.members()
        cells = index.cells()
        if repo is not None:
            self.members, cells = self.members.where(F.col("repo") == repo), cells.where(F.col("repo") == repo)
        self.reach = staged(self._reach(cells), "cell-reach")

    def _reach(self, cells: DataFrame) -> DataFrame:
        """(query, repo, cell, n, lower, first): the least distance that a vector of the cell can
        have, and whether the cell is among the nearest that hold the pool."""
        unit, odd = self.unit, pa.array([ODD], pa.int32())
        directed = (unit * unit).sum(axis=1) > 0

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("cell")
                c, _ = matrix_of(batch.column("centroid"), unit.shape[1])
                square = (c * c).sum(axis=1)[:, None] + 1 - 2 * (c @ unit.T)
                # A query without a direction is at distance 1 from everything: nothing is left out.
                d = np.where(directed, np.sqrt(np.maximum(square, 0)), 0.0)
                yield _pairs(cell, d)

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            yield _pairs(odd, np.where(directed, math.sqrt(2.0), 0.0)[None, :])

        schema = "cell int, query int, d double"
        near = self.index.centroids().mapInArrow(distances, schema)
        near = near.unionByName(self.index.spark.range(1, numPartitions=1).mapInArrow(apart, schema))
        near = near.join(cells, "cell")
        by = Window.partitionBy("query", "repo").orderBy("d", "cell").rowsBetween(Window.unboundedPreceding, -1)
        least = F.greatest(F.col("d") - F.col("radius"), F.lit(0.0))
        return near.select(
            "query", "repo", "cell", "n",
            (least * least / 2 - _SLACK).alias("lower"),
            (F.coalesce(F.sum("n").over(by), F.lit(0)) < self.pool).alias("first"),
        )

    def _read(self, asked: DataFrame, name: str) -> DataFrame:
        """Rows of the asked (query, repo, cell, limit) within the limits, with their distances."""
        asked = staged(asked, name)
        # Cells are folders, so others are not opened; there are at most MOST_CELLS.
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]
        lists = asked.groupBy("cell", "repo").agg(F.collect_list(F.struct("query", "limit")).alias("asked"))
        rows = self.members.where(F.col("cell").isin(wanted)).join(broadcast_if_small(staged(lists, f"{name}-lists")), ["cell", "repo"])
        kept = [c for c in self.members.columns if c not in (self.vector, "cell")]
        out = T.StructType([*self.members.select(*kept).schema.fields, self.id_field, T.StructField("distance", T.DoubleType())])
        ids, unit, pool = self.ids, self.unit, self.pool
        id_type, vector = to_arrow_type(self.id_field.dataType), self.vector

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, good = matrix_of(batch.column(vector), unit.shape[1])
                m = unit_rows(m)
                place = np.unique(
                    np.stack([_codes(batch.column("cell")), _codes(batch.column("repo"))]), axis=1, return_inverse=True
                )[1].reshape(-1)
                for group in range(int(place.max()) + 1 if len(place) else 0):
                    rows = np.flatnonzero(place == group)
                    asks = batch.column("asked")[int(rows[0])].values
                    queries = asks.field("query").to_numpy(zero_copy_only=False)
                    limits = asks.field("limit").fill_null(np.inf).to_numpy(zero_copy_only=False)
                    distance = np.round(1.0 - m[rows] @ unit[queries].T, DISTANCE_DECIMALS)
                    distance[~good[rows]] = 1.0
                    if len(rows) > pool:
                        limits = np.minimum(limits, np.partition(distance, pool - 1, axis=0)[pool - 1])
                    row, query = np.nonzero(distance <= limits[None, :])
                    if len(row):
                        index = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[batch.column(c).take(index) for c in kept],
                                pa.array([ids[q] for q in queries[query]], id_type),
                                pa.array(distance[row, query]),
                            ],
                            [*kept, "query_id", "distance"],
                        )

        found = rows.select("cell", vector, "asked", *kept).mapInArrow(score, out)
        return staged(found, f"{name}-found")

    def _second(self) -> tuple[DataFrame, DataFrame]:
        """What the first cells hold, and the (query, repo, cell, limit) to read after them."""
        none = F.lit(None).cast("double").alias("limit")
        found = self._read(self.reach.where("first").select("query", "repo", "cell", none), "cells-first")
        numbers = [(i, q) for i, q in enumerate(self.ids)]
        schema = T.StructType([T.StructField("query", T.IntegerType()), self.id_field])
        number = broadcast_if_small(self.index.spark.createDataFrame(numbers, schema))
        nearest = self._top(found).groupBy("query_id", "repo").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("held"))
        nearest = nearest.where(F.col("held") >= self.pool).join(number, "query_id").select("query", "repo", "limit")
        later = self.reach.where("NOT first").join(broadcast_if_small(staged(nearest, "cell-limits")), ["query", "repo"], "left")
        later = later.where(F.col("limit").isNull() | (F.col("lower") <= F.col("limit")))
        return found, later.select("query", "repo", "cell", "limit")

    def _top(self, rows: DataFrame) -> DataFrame:
        return top_of_groups(rows, ["query_id", "repo"], [F.col("distance"), *map(F.col, self.order)], self.pool)

    def nearest(self) -> DataFrame:
        found, later = self._second()
        return self._top(found.unionByName(self._read(later, "cells-later")))

    def report(self) -> DataFrame:
        _, later = self._second()
        read = later.select("query", "repo", "cell").unionByName(self.reach.where("first").select("query", "repo", "cell"))
        marked = self.reach.join(read.withColumn("read", F.lit(True)), ["query", "repo", "cell"], "left")
        is_read = F.coalesce("read", F.lit(False))
        ids = F.create_map(*(F.lit(x) for i, q in enumerate(self.ids) for x in (i, q)))
        return marked.groupBy("query", "repo").agg(
            F.count(F.lit(1)).alias("cells"),
            F.sum("n").alias("vectors"),
            F.count_if(is_read).alias("cells_read"),
            F.sum(F.when(is_read, F.col("n")).otherwise(0)).alias("vectors_read"),
        ).select(ids[F.col("query")].alias("query_id"), "repo", "cells", "vectors", "cells_read", "vectors_read")


def _pairs(cell: pa.Array, d: np.ndarray) -> pa.RecordBatch:
    """A row for each cell (row of ``d``) and query (column)."""
    n, queries = d.shape
    number = np.tile(np.arange(queries, dtype=np.int32), n)
    return pa.RecordBatch.from_arrays(
        [cell.take(pa.array(np.repeat(np.arange(n), queries))), pa.array(number), pa.array(d.reshape(-1))], ["cell", "query", "d"]
    )


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
