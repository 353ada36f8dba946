"""Vector tables: chunk, limit, embed, classify and check in one narrow pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import classify
from ..functions.vectors import EmbedFn, embedder, normalize
from ..operators import semantic
from ..operators.cells import CellIndex, build_cells
from ..operators.chunks import source_chunks
from ..operators.ignore import embed_allowed, embed_text
from ..functions.text import limit_chunks
from ..sources.store import Store


def embedded_chunks(
    files: DataFrame,
    make_embed: Callable[[], EmbedFn],
    *,
    use_policy: bool = True,
    include_solution: bool = True,
    tokens: str = "words",
    normalized: bool = True,
    on_error: str = "raise",
) -> DataFrame:
    """Vector rows of files (doc_id, repo, path, text); nothing is shuffled.

    Each row carries the class of its file, taken from the file's first chunk. With
    ``use_policy`` files that the embedding policy refuses are left out.
    """
    if use_policy:
        files = files.where(embed_allowed())
    chunks = limit_chunks(
        source_chunks(text="body", include_solution=include_solution), tokens=tokens
    )
    rows = (
        files.withColumn("body", embed_text())
        .select("doc_id", "repo", "path", chunks.alias("cs"))
        .where(F.size("cs") > 0)
        .withColumn("class", classify("path", F.col("cs")[0]["content"]))
        .select("doc_id", "repo", "path", "class", F.posexplode("cs").alias("chunk_index", "c"))
    )
    vector = embedder(make_embed, on_error=on_error)("content")
    out = rows.select(
        "doc_id", "repo", "path", "chunk_index", "c.start_line", "c.end_line", "c.content", "class.*"
    ).withColumn("vector", vector)
    return out.withColumn("vector", normalize("vector").cast("array<float>")) if normalized else out


def skipped_by_policy(files: DataFrame) -> DataFrame:
    """(doc_id, vector_index_error) of the files that are not to be embedded."""
    return files.where(~embed_allowed()).select(
        "doc_id", F.lit("embed_skipped_by_policy").alias("vector_index_error")
    )


def build_vectors(
    store: Store,
    make_embed: Callable[[], EmbedFn],
    batch: int,
    *,
    repo: str | None = None,
    dim: int = fixed.VECTOR_DIM,
    use_policy: bool = True,
    on_error: str = "null",
) -> DataFrame:
    """Embed the live documents (all, or one repo's) into a new batch and mark them.

    Only vectors and document marks are written; texts, postings and symbols stay.
    """
    files = store.files()
    docs = store.documents()
    if repo is not None:
        docs = docs.where(F.col("repo") == repo)
        files = files.where(F.col("repo") == repo)
        if docs.head() is None:
            raise ValueError(f"repo {repo!r} is not indexed")
    rows = embedded_chunks(files, make_embed, use_policy=use_policy, on_error=on_error)
    stage = store.folder("embedded", batch)
    rows.write.mode("overwrite").parquet(stage)
    rows = store.spark.read.parquet(stage)
    errors = semantic.vector_errors(rows, dim)
    if use_policy:
        errors = errors.unionByName(skipped_by_policy(files))
    store.write("vectors", batch, semantic.usable_vectors(rows, dim))
    marked = docs.drop("batch", "vector_batch", "vector_indexed_at", "vector_index_error").join(
        errors, "doc_id", "left"
    )
    fine = F.col("vector_index_error").isNull()
    marks = {
        "deleted": F.lit(False),
        "vector_batch": F.when(fine, batch),
        "vector_indexed_at": F.when(fine, F.current_timestamp()),
    }
    store.write("documents", batch, marked.withColumns(marks))
    written = store.batch_rows("vectors", batch)
    return written.agg(
        F.count("*").alias("chunks_indexed"), F.countDistinct("doc_id").alias("documents_processed")
    )


KEY = ("path", "chunk_index")  # of a chunk inside its repo


def index_vectors(store: Store, name: str, **options) -> CellIndex:
    """Build the cell index ``name`` of all live vectors in the store; see :func:`build_cells`
    for the options. Vectors of later batches are put in with :meth:`CellIndex.add`."""
    rows = store.live("vectors").select("repo", *KEY, *_FLAGS, "vector")
    return build_cells(rows, store.folder(f"cells-{name}"), order=KEY, **options)


def search_vectors(store: Store, queries: DataFrame, index: str | None = None, **options) -> DataFrame:
    """:func:`semantic.semantic_search` over the live vectors of a store, through the index of
    that name if one is given. Vectors that the index has and that are no longer live are
    left out before the pools are cut."""
    live = store.live("vectors")
    if index is None:
        return semantic.semantic_search(live, queries, order=KEY, **options)
    cells = _LiveCells(store.spark, store.folder(f"cells-{index}"))
    cells.live = live.select("repo", *KEY)
    return semantic.semantic_search(live, queries, order=KEY, index=cells, **options)


_FLAGS = ("is_code", "is_doc", "is_config", "is_data")


class _LiveCells(CellIndex):
    """A cell index that reads live rows only. Its cells may count vectors that are gone; a
    search then finds its first cells short of the pool and reads on."""

    live: DataFrame

    def members(self) -> DataFrame:
        return super().members().join(self.live, ["repo", *KEY], "left_semi")
