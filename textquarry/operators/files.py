"""File tables: registry, listing, reading, blobs, upserts and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.text import content_hash, decode_utf8, truncate_bytes
from .sizing import broadcast_if_small, staged

DOC_KEY = ["repo", "path"]


def decoded(raw: DataFrame) -> DataFrame:
    """(repo, path, content BINARY) with text, hash of the bytes, size and language."""
    return raw.select(
        "*",
        decode_utf8("content").alias("text"),
        content_hash("content").alias("blob_sha"),
        F.octet_length("content").cast("long").alias("size"),
        paths.language_of("path").alias("language"),
    )


def documents_of(files: DataFrame) -> DataFrame:
    """Document rows (doc_id, repo, path, blob_sha, size, language) of a text file table."""
    doc_id = F.col("doc_id") if "doc_id" in files.columns else F.xxhash64("repo", "path")
    return files.select(
        doc_id.alias("doc_id"),
        "repo",
        "path",
        content_hash("text").alias("blob_sha"),
        F.octet_length("text").cast("long").alias("size"),
        paths.language_of("path").alias("language"),
    )


# --- registry and generic row upserts --------------------------------------------------------


def upsert_repos(old: DataFrame, new: DataFrame, *, insert_only: bool = False) -> DataFrame:
    """Insert or update repos by name; ``insert_only`` leaves known repos untouched."""
    others = [c for c in old.columns if c != "repo"]
    both = old.alias("o").join(new.alias("n"), F.col("o.repo") == F.col("n.repo"), "full_outer")
    first, second = ("o", "n") if insert_only else ("n", "o")

    sides = {"o": old.columns, "n": new.columns}

    def pick(c: str) -> Column:
        have = [F.col(f"{s}.{c}") for s in (first, second) if c in sides[s]]
        return F.coalesce(*have).alias(c)

    return both.select(F.coalesce("n.repo", "o.repo").alias("repo"), *[pick(c) for c in others])


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str] = DOC_KEY) -> DataFrame:
    """``new`` rows in place of ``old`` rows with the same key."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_rows(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def update_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    test = F.coalesce(condition, F.lit(False))
    return table.withColumns(
        {
            c: F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
            for c, v in values.items()
        }
    )


def documents_with_repo(documents: DataFrame, repos: DataFrame) -> DataFrame:
    """Documents with their repo's own path as ``repo_path`` (and when it was indexed)."""
    columns = [c for c in repos.columns if c not in ("repo", "path")]
    registry = repos.select("repo", F.col("path").alias("repo_path"), *columns)
    return documents.join(broadcast_if_small(registry), "repo")


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.select("repo", "path").orderBy("repo")


# --- blobs --------------------------------------------------------------------------------------


def blobs_of(files: DataFrame) -> DataFrame:
    """One row per distinct content: (blob_sha, text).

    Copies are found on hashes and keys alone, and the texts that are copies of another are
    taken out; no text is shuffled while the keys of the copies are few. Files without a text
    have no blob.
    """
    keys = ["doc_id"] if "doc_id" in files.columns else DOC_KEY
    rows = files.where(F.col("text").isNotNull()).select(*keys, content_hash("text").alias("blob_sha"), "text")
    return first_blobs(rows, keys).select("blob_sha", "text")


def first_blobs(rows: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Of rows (keys, blob_sha, ...) with unique keys one for each content, and none whose
    content is among the ``stored`` (blob_sha)."""
    hashes = staged(rows.select(F.struct(*keys).alias("key"), "blob_sha"), "blob-hashes")
    first = hashes.groupBy("blob_sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    several = broadcast_if_small(staged(first.where("n > 1").select("blob_sha", "first"), "blob-groups"))
    copies = hashes.join(several, "blob_sha").where("key <> first").select("key.*")
    if stored is not None:
        # The log of stored blobs is scanned where it is, for the hashes of these rows.
        mine = broadcast_if_small(first.select("blob_sha"))
        known = broadcast_if_small(staged(stored.select("blob_sha").join(mine, "blob_sha", "left_semi").distinct(), "known-blobs"))
        copies = copies.unionByName(hashes.join(known, "blob_sha", "left_semi").select("key.*")).distinct()
    return rows.join(broadcast_if_small(staged(copies, "blob-copies")), keys, "left_anti")


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Write-once: the blobs not yet stored. Hashes meet first, so that texts are shuffled
    only where very many of them are stored already."""
    hashes = stored.select("blob_sha").distinct()
    known = blobs.select("blob_sha").join(hashes, "blob_sha", "left_semi")
    return blobs.join(broadcast_if_small(known), "blob_sha", "left_anti")


def read_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    return documents.join(blobs, "blob_sha")


def blob_refs(documents: DataFrame) -> DataFrame:
    return documents.groupBy("blob_sha").agg(F.count("*").alias("refs"))


def orphan_blobs(blobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Blobs that no document uses any more."""
    return blobs.join(documents.select("blob_sha").distinct(), "blob_sha", "left_anti")


# --- reading --------------------------------------------------------------------------------------


def read_files(
    files: DataFrame, wanted: DataFrame | None = None, max_bytes: int = fixed.READ_BYTES
) -> DataFrame:
    """(repo, path, text) cut to ``max_bytes`` bytes, for all or the wanted (repo, path)."""
    if wanted is not None:
        files = files.join(broadcast_if_small(wanted.select(*DOC_KEY).distinct()), DOC_KEY)
    return files.select("repo", "path", truncate_bytes("text", max_bytes).alias("text"))


def fetch(files: DataFrame, ids: DataFrame, max_bytes: int = fixed.FETCH_BYTES) -> DataFrame:
    """Documents by ``repo::path`` id: (id, title, text, url, metadata).

    An id without ``::`` is an error; an id that names no file has a null text.
    """
    parsed = ids.select(
        F.when(F.contains("id", F.lit("::")), F.col("id"))
        .otherwise(F.raise_error(F.concat(F.lit("invalid document id: "), F.col("id"))).cast("string"))
        .alias("id")
    ).select(
        "id",
        F.substring_index("id", "::", 1).alias("repo"),
        F.expr("substring(id, locate('::', id) + 2)").alias("path"),
    )
    # The few ids go to the texts, not the texts to the ids.
    keys = broadcast_if_small(parsed.select(*DOC_KEY).distinct())
    found = files.select(*DOC_KEY, "text").join(keys, DOC_KEY)
    return parsed.join(found, DOC_KEY, "left").select(
        "id",
        paths.hit_title("repo", "path").alias("title"),
        truncate_bytes("text", max_bytes).alias("text"),
        paths.hit_url("repo", "path").alias("url"),
        F.struct("repo", "path").alias("metadata"),
    )


def list_entries(
    files: DataFrame,
    repo: str | None = None,
    subdir: str = ".",
    *,
    max_depth: int = 4,
    include_hidden: bool = False,
    max_entries: int | None = 1000,
) -> DataFrame:
    """Files and the directories above them: (type, repo, path), in that order.

    ``max_depth`` counts the directories walked into, so an entry lies at most one level
    deeper. Directories come from file paths; empty ones do not show. With ``max_entries``
    the first entries in order are kept.
    """
    base = "/".join(p for p in subdir.split("/") if p not in ("", "."))
    if repo is not None:
        files = files.where(F.col("repo") == repo)
    if base:
        files = files.where(F.startswith("path", F.lit(base + "/")))
    skipped = len(base.split("/")) if base else 0
    ps = F.col("parts")
    split = files.select("repo", "path", paths.parts("path").alias("parts"))
    if not include_hidden:
        # A hidden directory hides all below it; a hidden file only itself.
        seen = F.slice(ps, skipped + 1, F.greatest(F.size(ps) - skipped - 1, F.lit(0)))
        split = split.withColumn("visible", F.transform(seen, lambda x: ~F.startswith(x, F.lit("."))))
        open_dirs = F.aggregate(
            "visible",
            F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")),
            lambda a, v: F.struct(
                (a["open"] & v).alias("open"), (a["n"] + (a["open"] & v).cast("int")).alias("n")
            ),
        )["n"]
        dirs_shown = open_dirs
        file_shown = F.forall("visible", lambda v: v) & ~F.startswith(
            F.element_at(ps, -1), F.lit(".")
        )
    else:
        dirs_shown = F.size(ps) - skipped - 1
        file_shown = F.lit(True)
    deepest = F.least(dirs_shown, F.lit(max_depth + 1))
    dirs = (
        split.withColumn("deepest", deepest)
        .where(F.col("deepest") > 0)
        .select(
            "repo",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.col("deepest")),
                    lambda n: F.array_join(F.slice(ps, 1, n + skipped), "/"),
                )
            ).alias("path"),
        )
        .distinct()
        .select(F.lit("dir").alias("type"), "repo", "path")
    )
    leaves = split.where(file_shown & (F.size(ps) - skipped <= max_depth + 1)).select(
        F.lit("file").alias("type"), "repo", "path"
    )
    out = dirs.unionByName(leaves)
    if max_entries is not None:
        out = out.orderBy("type", "repo", "path").limit(max_entries)
    return out


# --- change detection -----------------------------------------------------------------------------


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, change) with change new / changed / unchanged / deleted, by content hash.

    A file that is there without a hash could not be read: its change is ``unreadable``,
    whatever is known of it.
    """
    o = old.select(*DOC_KEY, F.col("blob_sha").alias("old_sha"), F.lit(True).alias("was"))
    n = new.select(*DOC_KEY, F.col("blob_sha").alias("new_sha"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("is").isNull(), "deleted")
        .when(F.col("new_sha").isNull(), "unreadable")
        .when(F.col("was").isNull(), "new")
        .when(F.col("old_sha") == F.col("new_sha"), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, DOC_KEY, "full_outer").select(*DOC_KEY, change.alias("change"))
