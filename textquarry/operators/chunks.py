"""Chunk tables: files cut into line windows or records, limited in size, reported on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.records import canonical_record, canonical_record_exact, record_lines
from ..functions.text import CHUNK_TYPE, chunks, limit_chunks, lines, oversized


def line_table(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., line, text): every line of every file, numbered from 1."""
    return files.select(*keys, F.posexplode(lines("text")).alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).alias("line"), "text"
    )


def chunk_table(
    files: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    max_lines: int = fixed.CHUNK_LINES,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """(keys..., chunk_index, start_line, end_line, content) of plain line windows."""
    return _explode(files, keys, chunks("text", max_lines, overlap))


def _explode(files: DataFrame, keys: tuple[str, ...], array: Column) -> DataFrame:
    return files.select(*keys, F.posexplode(array).alias("chunk_index", "c")).select(
        *keys, "chunk_index", "c.start_line", "c.end_line", "c.content"
    )


def source_chunks(
    path: str = "path",
    text: str = "text",
    *,
    include_solution: Column | bool = True,
    max_lines: int = fixed.CHUNK_LINES,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> Column:
    """Chunks of a file: one per record for JSONL, line windows for everything else."""
    records = F.transform(
        record_lines(text),
        lambda r: F.struct(
            F.lit(1).alias("start_line"),
            F.lit(1).alias("end_line"),
            canonical_record(r, include_solution).alias("content"),
        ),
    ).cast(CHUNK_TYPE)
    return F.when(paths.is_jsonl(path), records).otherwise(chunks(text, max_lines, overlap))


def embedding_chunks(
    files: DataFrame, keys: tuple[str, ...] = ("doc_id", "repo", "path"), **limits
) -> DataFrame:
    """Chunks of files (with ``path`` and ``text``) ready to embed, none above the limits."""
    solution = limits.pop("include_solution", True)
    return _explode(files, keys, limit_chunks(source_chunks(include_solution=solution), **limits))


def record_table(
    files: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    *,
    include_solution: bool = True,
    exact: bool = False,
) -> DataFrame:
    """(keys..., record, content): canonical text of every JSONL record."""
    rows = files.select(*keys, F.posexplode(record_lines("text")).alias("record", "line"))
    text = (
        canonical_record_exact("line", F.lit(include_solution))
        if exact
        else canonical_record("line", include_solution)
    )
    return rows.select(*keys, "record", text.alias("content"))


def hard_wrap_report(
    files: DataFrame,
    *,
    top_n: int | None = 50,
    min_hardwraps: int | None = None,
    tokens: str = "words",
    hard_chars: int = fixed.HARD_CHARS,
    max_tokens: int = fixed.MAX_TOKENS,
) -> DataFrame:
    """Files with oversized chunks: (repo, path, oversized_count, total_chunks), worst first.

    Counted inside each row, so no text is shuffled. ``min_hardwraps`` filters after the cut
    to ``top_n``.
    """
    counted = files.select("repo", "path", source_chunks().alias("cs")).select(
        "repo",
        "path",
        F.size(
            F.filter(
                "cs",
                lambda c: oversized(
                    c["content"], tokens=tokens, hard_chars=hard_chars, max_tokens=max_tokens
                ),
            )
        )
        .cast("long")
        .alias("oversized_count"),
        F.size("cs").cast("long").alias("total_chunks"),
    )
    out = counted.where(F.col("oversized_count") > 0)
    if top_n is not None:
        out = out.orderBy(F.desc("oversized_count"), "repo", "path").limit(top_n)
    if min_hardwraps is not None:
        out = out.where(F.col("oversized_count") >= min_hardwraps)
    return out
