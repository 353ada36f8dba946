"""Nearest-neighbour search over chunk vectors with reranking, and vector table upkeep."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, vectors
from .sizing import broadcast_if_small, staged

QUERIES_PER_PASS = 4096
# Copies of a vector must tie whatever row of a matrix product they came from.
DISTANCE_DECIMALS = 9
_BLOCK = 1 << 22  # distances held at once per task
_HELD = 1 << 17  # candidate rows held at least before they are cut again
_PASS_ROWS = 1 << 23  # candidate rows that a pass leaves with a task, about
_FEW_ROWS = 2000  # of one repo: below these repos are not counted
# Spark cuts groups before the shuffle only for ranks up to its window group limit; larger
# pools first rank inside salted sub-groups.
_GROUP_LIMIT = 1000
_SALT = 64


def pool_size(
    k: int, candidate_limit: int | None = None, code_only: bool = False, prefer_code: bool = False
) -> int:
    """Candidates fetched per repo before reranking."""
    pool = min(max(candidate_limit or max(k * 5, 50), k), 200)
    if code_only:
        return max(pool, k * 5)
    return max(pool, k * 4) if prefer_code else pool


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, and which rows have the right length."""
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()])
    good = lengths == dim
    flat = np.asarray(column.filter(pa.array(good)).flatten(), dtype="float64")
    out = np.zeros((len(column), dim))
    out[good] = flat.reshape(-1, dim)
    return out, good


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def nearest(
    chunks: DataFrame,
    queries: DataFrame,
    pool: int,
    *,
    vector: str = "vector",
    order: Sequence[str] = ("chunk_id",),
) -> DataFrame:
    """The ``pool`` nearest chunks per query and repo: chunk columns, query_id, distance.

    ``queries`` has (query_id, vector). Distance is one minus cosine similarity; a vector of
    another length is at distance 1. Each task scores its chunks against the query matrix,
    holds the nearest rows of every query and repo through its whole partition, and passes
    them on at the end: at most repos * queries * ``pool`` rows a partition, which bounds the
    queries of a pass. Queries beyond one pass are split by a hash of their id into more
    passes over the chunks.
    """
    total = queries.count()
    most = QUERIES_PER_PASS
    if total * pool > _FEW_ROWS:
        repos = chunks.agg(F.approx_count_distinct("repo").alias("n")).first()["n"]
        most = max(1, min(most, _PASS_ROWS // (pool * max(repos, 1))))
    passes = max(1, -(-total // most))
    scored = None
    for part in range(passes):
        some = queries
        if passes > 1:
            some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part)
        found = _score(chunks, some, pool, vector, order)
        scored = found if scored is None else scored.unionByName(found)
    return top_of_groups(scored, ["query_id", "repo"], [F.col("distance"), *map(F.col, order)], pool)


def top_of_groups(rows: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; hot groups are cut on the map side or in salted parts."""
    if n > _GROUP_LIMIT:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALT)))
        w = Window.partitionBy(*groups, "__salt").orderBy(*order)
        rows = salted.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
        rows = rows.drop("__n", "__salt")
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def _score(
    chunks: DataFrame, queries: DataFrame, pool: int, vector: str, order: Sequence[str]
) -> DataFrame:
    known = [(r["query_id"], list(r["vector"])) for r in queries.select("query_id", "vector").collect()]
    id_field = queries.schema["query_id"]
    id_arrow = to_arrow_type(id_field.dataType)
    kept = [c for c in chunks.columns if c != vector]
    schema = chunks.select(*kept).schema.add(id_field).add("distance", T.DoubleType())
    dims = {len(v) for _, v in known}
    if len(dims) > 1:
        raise ValueError("query vectors must have one length")
    dim = dims.pop() if dims else 0
    wanted = np.array([v for _, v in known], dtype="float64").reshape(len(known), dim)
    unit_queries = unit_rows(wanted) if known else wanted
    ids = [q for q, _ in known]
    repo_at = kept.index("repo")
    ties = [kept.index(c) for c in order]

    def nearest_in(row_groups, distance: np.ndarray) -> np.ndarray:
        """Rows that can be among the ``pool`` nearest of their repo; ties all stay."""
        keep = []
        for rows in row_groups:
            if len(rows) > pool:
                d = distance[rows]
                rows = rows[d <= np.partition(d, pool - 1)[pool - 1]]
            keep.append(rows)
        return np.concatenate(keep)

    def cut(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """The ``pool`` nearest rows of each query and repo, ties settled by the order columns."""
        rows = pa.Table.from_batches(held).combine_chunks()
        names = [f"c{i}" for i in range(rows.num_columns)]
        rows = rows.rename_columns(names)
        by = [names[-2], names[repo_at], names[-1], *(names[i] for i in ties)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by]))
        codes = [rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in by[:2]]
        head = np.ones(rows.num_rows, bool)
        head[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
        places = np.arange(rows.num_rows)
        places -= np.maximum.accumulate(np.where(head, places, 0))
        rows = rows.filter(pa.array(places < pool)).rename_columns([*kept, "query_id", "distance"])
        return rows.combine_chunks().to_batches()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        held: list[pa.RecordBatch] = []
        n_held, limit = 0, _HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            m, good = matrix_of(batch.column(0), dim)
            m = unit_rows(m)
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], kept)
            codes = np.asarray(rest.column(repo_at).dictionary_encode().indices.fill_null(-1))
            groups = [np.flatnonzero(codes == c) for c in np.unique(codes)]
            step = max(1, _BLOCK // len(m))
            for at in range(0, len(ids), step):
                distance = np.round(1.0 - m @ unit_queries[at : at + step].T, DISTANCE_DECIMALS)
                distance[~good] = 1.0
                for j in range(distance.shape[1]):
                    rows = nearest_in(groups, distance[:, j])
                    index = pa.array(rows)
                    held.append(
                        pa.RecordBatch.from_arrays(
                            [
                                *[c.take(index) for c in rest.columns],
                                pa.array([ids[at + j]] * len(rows), id_arrow),
                                pa.array(distance[rows, j]),
                            ],
                            [*kept, "query_id", "distance"],
                        )
                    )
                    n_held += len(rows)
                    if n_held > limit:
                        held = cut(held)
                        n_held = sum(b.num_rows for b in held)
                        limit = max(_HELD, 2 * n_held)
        if held:
            yield from cut(held)

    return chunks.select(vector, *kept).mapInArrow(score, schema)


def weight(prefer_code: bool = False) -> Column:
    """Rerank weight: the first flag that is set decides."""
    chain = None
    for flag, w in fixed.RERANK_PREFER_CODE if prefer_code else fixed.RERANK_DEFAULT:
        test = F.coalesce(F.col(flag), F.lit(flag == "is_code"))
        chain = F.when(test, w) if chain is None else chain.when(test, w)
    return chain.otherwise(F.lit(1.0))


def rerank(candidates: DataFrame, *, prefer_code: bool = False) -> DataFrame:
    """Candidates with ``score`` and ``language_authoritative``."""
    closeness = 1.0 / (1.0 + F.greatest(F.col("distance"), F.lit(fixed.MIN_DISTANCE)))
    return candidates.withColumns(
        {
            "score": F.least(F.lit(1.0), closeness * weight(prefer_code)),
            "language_authoritative": F.coalesce(F.col("is_code"), F.lit(True)),
        }
    )


def semantic_search(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    repo: str | None = None,
    k: int = 20,
    code_only: bool = False,
    prefer_code: bool = False,
    candidate_limit: int | None = None,
    vector: str = "vector",
    order: Sequence[str] = ("chunk_id",),
    index=None,
) -> DataFrame:
    """Top ``k`` chunks per query: nearest pool per repo, rerank, cut.

    ``code_only`` filters after the pool is cut. An unknown repo is an error; an empty
    vector table gives no rows. With ``index``, a :class:`cells.CellIndex` of the chunks'
    repo, order, flag and vector columns, the same pools are found without reading every
    vector.
    """
    if repo is not None:
        if chunks.where(F.col("repo") == repo).select(F.lit(1)).head() is None:
            raise ValueError(f"unknown repo {repo!r}")
        chunks = chunks.where(F.col("repo") == repo)
    pool = pool_size(k, candidate_limit, code_only, prefer_code)
    # Only what ranks goes through the pools; the winners fetch the rest.
    key = list(dict.fromkeys(["repo", *order]))
    flags = [c for c in chunks.columns if c.startswith("is_") and c not in key]
    if index is None:
        pools = nearest(chunks.select(*key, *flags, vector), queries, pool, vector=vector, order=order)
    else:
        pools = index.nearest(queries, pool, vector=vector, order=order, repo=repo)
        pools = pools.select(*key, *flags, "query_id", "distance")
    ranked = rerank(pools, prefer_code=prefer_code)
    if code_only:
        ranked = ranked.where(F.col("language_authoritative"))
    by = [F.desc("score"), F.col("distance"), F.col("repo"), *map(F.col, order)]
    best = top_of_groups(ranked, ["query_id"], by, k)
    more = [c for c in chunks.columns if c not in (*key, *flags, vector)]
    if not more:
        return best
    best = staged(best, "winners")
    match = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in key))
    wanted = broadcast_if_small(best.select(*key).distinct())
    rest = chunks.select(*key, *more)
    rest = staged(rest.join(wanted, match(rest, wanted), "left_semi"), "winners-rest")
    joined = best.join(rest, match(best, rest), "left")
    made = [c for c in best.columns if c not in chunks.columns]
    columns = [rest[c] if c in more else best[c] for c in chunks.columns if c != vector]
    return joined.select(*columns, *[best[c] for c in made])


def embed_queries(queries: DataFrame, embed: vectors.EmbedFn) -> DataFrame:
    """(query_id, query) to (query_id, vector), L2-normalised."""
    column = vectors.embedder(lambda: embed)
    embedded = queries.select("query_id", column("query").alias("vector"))
    return embedded.withColumn("vector", vectors.normalize("vector"))


# --- vector tables -------------------------------------------------------------------------------


def usable_vectors(rows: DataFrame, dim: int, *, vector: str = "vector") -> DataFrame:
    """Normalised rows of documents whose every vector has ``dim`` elements.

    A document with a missing or wrong vector is left out as a whole; see
    :func:`vector_errors` for which. ``rows`` is read more than once, so pass a stored table.
    """
    bad = broadcast_if_small(rows.where(~_fits(vector, dim)).select("doc_id").distinct())
    return rows.join(bad, "doc_id", "left_anti").withColumn(
        vector, vectors.normalize(vector).cast("array<float>")
    )


def vector_errors(rows: DataFrame, dim: int, *, vector: str = "vector") -> DataFrame:
    """(doc_id, vector_index_error) of the documents that :func:`usable_vectors` refuses:
    ``embeddings_unavailable`` where a vector is missing, else ``vector_upsert_failed``."""
    missing = F.count_if(F.col(vector).isNull())
    return (
        rows.groupBy("doc_id")
        .agg(missing.alias("missing"), F.count_if(~_fits(vector, dim)).alias("bad"))
        .where(F.col("bad") > 0)
        .select(
            "doc_id",
            F.when(F.col("missing") > 0, "embeddings_unavailable")
            .otherwise("vector_upsert_failed")
            .alias("vector_index_error"),
        )
    )


def _fits(vector: str, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))


def dimension_audit(rows: DataFrame, configured: int, *, vector: str = "vector") -> DataFrame:
    """Vectors per stored dimension and whether it is the configured one."""
    return (
        rows.groupBy(F.size(vector).alias("dim"))
        .agg(F.count("*").alias("vectors"))
        .withColumn("matches", F.col("dim") == configured)
    )


def alignment(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Vectors whose repo is unknown, per repo name (exact, over the whole table)."""
    return (
        rows.groupBy("repo")
        .agg(F.count("*").alias("vectors"))
        .join(repos.select("repo"), "repo", "left_anti")
    )


def move_metadata(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rewrite repo and path of the vectors of moved documents (doc_id, repo, path)."""
    target = moves.select(
        "doc_id", F.col("repo").alias("__repo"), F.col("path").alias("__path")
    )
    return (
        rows.join(broadcast_if_small(target), "doc_id", "left")
        .withColumns(
            {"repo": F.coalesce("__repo", "repo"), "path": F.coalesce("__path", "path")}
        )
        .drop("__repo", "__path")
        .select(*rows.columns)
    )


def mean_pool(
    segments: DataFrame,
    keys: list[str],
    dim: int,
    *,
    vector: str = "vector",
    count_mismatched: bool = False,
) -> DataFrame:
    """Element-wise mean of the segment vectors of each key: (keys..., vector, segments).

    Vectors of another length are left out. ``count_mismatched`` still counts them in the
    divisor.
    """
    good = _fits(vector, dim)
    v = F.when(good, F.col(vector))
    pooled = segments.withColumn("__v", v).groupBy(*keys).agg(
        vectors.mean_of("__v", dim).alias(vector),
        F.count_if(good).alias("segments"),
        F.count("*").alias("__all"),
    )
    if count_mismatched:
        scale = F.col("segments") / F.col("__all")
        pooled = pooled.withColumn(vector, F.transform(vector, lambda x: x * scale))
    return pooled.where(F.col("segments") > 0).drop("__all")
