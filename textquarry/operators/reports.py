"""Health reports over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .sizing import broadcast_if_small


def index_stats(
    repos: DataFrame, documents: DataFrame, symbols: DataFrame, pairs: DataFrame
) -> DataFrame:
    """One row: repositories, documents, symbols and distinct trigrams."""

    def total(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        return df.agg((F.count("*") if value is None else value).alias("n")).select(
            F.lit(name).alias("what"), "n"
        )

    parts = [
        total(repos, "repositories"),
        total(documents, "documents"),
        total(symbols, "symbols"),
        total(pairs, "trigrams", F.countDistinct("gram")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["repositories", "documents", "symbols", "trigrams"]
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])


def repo_index_stats(
    repos: DataFrame, documents: DataFrame, symbols: DataFrame, repo: str | None = None
) -> DataFrame:
    """(repo, documents, symbols, indexed_at) per repo; one unknown repo is an error."""
    if repo is not None:
        repos = repos.where(F.col("repo") == repo)
        if repos.head() is None:
            raise ValueError(f"unknown repo {repo!r}")
        documents = documents.where(F.col("repo") == repo)
    per_doc = symbols.groupBy("doc_id").agg(F.count("*").alias("symbols"))
    counted = (
        documents.select("doc_id", "repo")
        .join(per_doc, "doc_id", "left")
        .groupBy("repo")
        .agg(
            F.count("*").alias("documents"),
            F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"),
        )
    )
    return repos.select("repo", "indexed_at").join(counted, "repo", "left").select(
        "repo",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("symbols", F.lit(0)).alias("symbols"),
        "indexed_at",
    )


def is_stale() -> Column:
    return F.col("vector_index_error").isNotNull() | F.col("vector_indexed_at").isNull()


def repo_stats(
    documents: DataFrame, symbols: DataFrame, vectors: DataFrame, files: DataFrame
) -> DataFrame:
    """Counts per repo and, with a null repo, over all of them.

    Every table is reduced to counts per repo on its own before the parts are added up, so
    no two tables are joined row by row except symbols with their documents.
    """
    names = ("documents", "symbols", "vectors", "files", "vectors_stale")

    def part(df: DataFrame, **columns: Column) -> DataFrame:
        counted = df.groupBy("repo").agg(*[c.alias(n) for n, c in columns.items()])
        return counted.select(
            "repo", *[F.coalesce(n, F.lit(0)).alias(n) if n in columns else F.lit(0).cast("long").alias(n) for n in names]
        )

    per_doc = symbols.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = documents.join(per_doc, "doc_id", "left")
    rows = (
        part(
            docs,
            documents=F.count("*"),
            symbols=F.sum("n"),
            vectors_stale=F.count_if(is_stale()),
        )
        .unionByName(part(vectors, vectors=F.count("*")))
        .unionByName(part(files, files=F.count("*")))
    )
    return rows.rollup("repo").agg(*[F.sum(n).alias(n) for n in names])


def top_dirs(files: DataFrame, n: int | None = 10) -> DataFrame:
    """Files per top-level directory, most first (a root file counts under its own name)."""
    counted = files.groupBy(F.substring_index("path", "/", 1).alias("top_dir")).agg(
        F.count("*").alias("files")
    )
    return counted if n is None else counted.orderBy(F.desc("files"), "top_dir").limit(n)


def scan_summary(decided: DataFrame) -> DataFrame:
    """One row: scanned, skipped, included and the first ten skipped paths."""
    counts = decided.agg(
        F.count("*").alias("scanned"),
        F.count_if("ignored").alias("skipped"),
        F.count_if(~F.col("ignored")).alias("included"),
    )
    # Ten rows at most reach this list.
    first = decided.where("ignored").select(paths.hit_id("repo", "path").alias("p")).orderBy("p").limit(10)
    examples = first.agg(F.array_sort(F.collect_list("p")).alias("skipped_examples"))
    return _beside(counts, examples)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row results next to each other."""
    return left.withColumn("__k", F.lit(1)).join(right.withColumn("__k", F.lit(1)), "__k").drop("__k")


def skip_reasons(decided: DataFrame) -> DataFrame:
    return decided.groupBy("reason", "ignored").agg(F.count("*").alias("files"))


def stale_documents(documents: DataFrame) -> DataFrame:
    """(repo, path, error) of every document whose vectors are missing or failed."""
    return documents.where(is_stale()).select(
        "repo", "path", F.col("vector_index_error").alias("error")
    )


def stale_page(documents: DataFrame, page: int, per_page: int = 20) -> DataFrame:
    """One page of the stale documents in (repo, path) order; pages start at 1."""
    ordered = stale_documents(documents).orderBy("repo", "path")
    return ordered.offset((page - 1) * per_page).limit(per_page)


def stale_report(documents: DataFrame, vectors: DataFrame, footprint: DataFrame | None = None) -> DataFrame:
    """(repo, vectors_stale, vectors_in_repo, bytes) per repo.

    The stale documents themselves come from :func:`stale_documents` as rows; a repo may
    have any number of them, so they are not gathered into one value.
    """
    docs = documents.groupBy("repo").agg(F.count_if(is_stale()).alias("vectors_stale"))
    vecs = vectors.groupBy("repo").agg(F.count("*").alias("vectors_in_repo"))
    out = docs.join(vecs, "repo", "left").fillna(0, ["vectors_in_repo"])
    if footprint is not None:
        out = out.join(footprint, "repo", "left").fillna(0, ["bytes"])
    return out


def footprint(files: DataFrame) -> DataFrame:
    """Stored bytes per repo."""
    return files.groupBy("repo").agg(F.sum("size").alias("bytes"))


def vector_build_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks_indexed"), F.countDistinct("doc_id").alias("documents_processed")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Totals over the rows of several index runs."""
    names = [c for c in runs.columns if c not in ("repo", "batch")]
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def orphans(documents: DataFrame, repos: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, key): documents without a repo and symbols without a document."""
    lost_docs = documents.join(broadcast_if_small(repos.select("repo")), "repo", "left_anti").select(
        F.lit("document").alias("kind"), paths.hit_id("repo", "path").alias("key")
    )
    lost_symbols = symbols.join(documents.select("doc_id"), "doc_id", "left_anti").select(
        F.lit("symbol").alias("kind"),
        F.concat_ws(":", F.col("doc_id").cast("string"), "name", F.col("line").cast("string")).alias("key"),
    )
    return lost_docs.unionByName(lost_symbols)
