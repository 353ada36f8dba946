"""Substring search: over texts, over postings, for one query or a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import paths
from ..functions.text import LINE_BREAK, lines, strip, trigrams
from . import postings
from .sizing import broadcast_if_small, staged

HIT_ORDER = ("repo", "path", "line")
SCAN_QUERIES = 50_000
SCAN_QUERY_CHARS = 16_000_000
NEEDLES = 4096  # queries to a list of needles, about


def _line_hits(docs: DataFrame, query: str, case_sensitive: bool) -> DataFrame:
    """Lines that contain the query, from documents that contain it at all."""
    if case_sensitive:
        found = docs.where(F.contains("text", F.lit(query)))
        hit = F.contains(F.col("raw"), F.lit(query))
    else:
        lowered = F.lower(F.lit(query))
        found = docs.where(F.contains(F.lower("text"), lowered))
        hit = F.contains(F.lower("raw"), lowered)
    return (
        found.select("repo", "path", F.posexplode(lines("text")).alias("pos", "raw"))
        .where(hit)
        .select(
            "repo",
            "path",
            (F.col("pos") + 1).alias("line"),
            strip("raw").alias("text"),
            paths.hit_id("repo", "path").alias("doc_id"),
        )
    )


def _cut(hits: DataFrame, max_results: int | None) -> DataFrame:
    return hits if max_results is None else hits.orderBy(*HIT_ORDER).limit(max_results)


def _in_repo(docs: DataFrame, repo: str | None, unknown: str = "empty") -> DataFrame:
    """Documents of a repo. ``unknown`` says what a repo without documents means: ``empty``,
    ``error``, or ``all`` for no restriction."""
    if repo is None:
        return docs
    kept = docs.where(F.col("repo") == repo)
    if unknown != "empty" and kept.select(F.lit(1)).head() is None:
        if unknown == "all":
            return docs
        raise ValueError(f"unknown repo {repo!r}")
    return kept


def search_code(
    files: DataFrame,
    query: str,
    repo: str | None = None,
    max_results: int | None = 50,
    *,
    unknown_repo: str = "empty",
) -> DataFrame:
    """Case-insensitive substring search, one row per matching line.

    Queries under three characters find nothing. An unknown repo finds nothing either,
    unless ``unknown_repo`` is ``all`` (search everything) or ``error``. ``files`` has
    (repo, path, text); the document test runs before lines are cut, so only matching
    documents are split.
    """
    if len(query) < 3:
        files = files.where(F.lit(False))
    return _cut(_line_hits(_in_repo(files, repo, unknown_repo), query, False), max_results)


def rarest_grams(pairs: DataFrame, query: str, most: int | None = 6) -> list[str]:
    """The grams of a query, or the ``most`` of them with the fewest documents."""
    lowered = query.lower()
    grams = sorted({lowered[i : i + 3] for i in range(len(lowered) - 2)})
    if most is None or len(grams) <= most:
        return grams
    counted = postings.gram_counts(pairs.where(F.col("gram").isin(*grams))).collect()
    size = {r["gram"]: r["n_docs"] for r in counted}
    return sorted(grams, key=lambda g: (size.get(g, 0), g))[:most]


def search_postings(
    pairs: DataFrame,
    files: DataFrame,
    query: str,
    repo: str | None = None,
    max_results: int | None = 50,
    rarest: int | None = 6,
) -> DataFrame:
    """The same search through stored postings.

    Only the ``rarest`` grams of the query are intersected (all of them when ``None``): any
    subset gives a superset of the documents, and the line test settles it. The sizes of
    at most len(query) postings are looked up on the driver. Candidates are kept in the
    shared folder and, when they measure small, reach the texts by broadcast, so that no
    text is shuffled.
    """
    files = _in_repo(files, repo)
    grams = rarest_grams(pairs, query, rarest)
    if not grams:
        return _cut(_line_hits(files.where(F.lit(False)), query, False), max_results)
    candidates = staged(postings.matching_docs(pairs, grams), "candidates")
    docs = files.join(broadcast_if_small(candidates), "doc_id", "left_semi")
    return _cut(_line_hits(docs, query, False), max_results)


def search_repo(
    files: DataFrame,
    query: str,
    repo: str | None = None,
    file_glob: str = "*.rs",
    max_results: int | None = 50,
) -> DataFrame:
    """Case-sensitive scan of the files whose path matches ``file_glob``.

    Hidden files and directories are left out unless the glob is exactly ``*``. An unknown
    repo is an error.
    """
    docs = _in_repo(files, repo, "error").where(paths.find_match("path", file_glob))
    if file_glob != "*":
        docs = docs.where(~paths.has_hidden_part("path"))
    return _cut(_line_hits(docs, query, True).drop("doc_id"), max_results)


def search_ids(
    files: DataFrame,
    query: str,
    repo: str | None = None,
    file_glob: str = "*",
    max_results: int | None = 50,
) -> DataFrame:
    """:func:`search_repo` as (id, title, url) entries, one per matching line."""
    hits = search_repo(files, query, repo, file_glob, max_results)
    return hits.select(
        paths.hit_id("repo", "path").alias("id"),
        paths.hit_title("repo", "path", "line").alias("title"),
        paths.hit_url("repo", "path").alias("url"),
    )


# --- many queries at once ------------------------------------------------------------------


def usable_queries(queries: DataFrame) -> DataFrame:
    """Queries that can hit at all: three characters or more and no line break inside."""
    return queries.select("query_id", F.lower("query").alias("needle")).where(
        (F.length("needle") >= 3) & ~F.rlike("needle", F.lit(LINE_BREAK))
    )


def search_many(files: DataFrame, queries: DataFrame, *, method: str = "auto") -> DataFrame:
    """Every line hit of every query: (query_id, repo, path, line, text).

    ``queries`` has (query_id, query). ``scan`` carries the queries to the tasks and reads
    each text once, without any shuffle; it is chosen when the queries are measured to be
    few. ``postings`` joins on the rarest grams of each query and has no such bound.
    """
    usable = usable_queries(queries)
    if method == "auto":
        size = usable.agg(F.count("*").alias("n"), F.sum(F.length("needle")).alias("chars")).first()
        small = size["n"] <= SCAN_QUERIES and (size["chars"] or 0) <= SCAN_QUERY_CHARS
        method = "scan" if small and _has_automaton() else "postings"
    if method == "scan":
        return _scan_many(files, usable)
    if method == "postings":
        return _join_many(files, usable)
    raise ValueError(f"unknown method {method!r}")


def _has_automaton() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True


def _scan_many(files: DataFrame, usable: DataFrame) -> DataFrame:
    by_needle: dict[str, list] = {}
    for r in usable.collect():  # size measured by the caller
        by_needle.setdefault(r["needle"], []).append(r["query_id"])
    needle_type = T.ArrayType(
        T.StructType([usable.schema["query_id"], T.StructField("needle", T.StringType())])
    )
    arrow_type = to_arrow_type(needle_type)
    schema = files.select("repo", "path", "text").schema.add("needles", needle_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not by_needle:
            return
        matcher = ahocorasick.Automaton()
        for needle in by_needle:
            matcher.add_word(needle, needle)
        matcher.make_automaton()
        for batch in batches:
            rows, needles = [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                found = {n for _, n in matcher.iter(text)} if text else ()
                if found:
                    rows.append(row)
                    needles.append(
                        [{"query_id": q, "needle": n} for n in found for q in by_needle[n]]
                    )
            index = pa.array(rows, pa.int32())
            kept = [batch.column(i).take(index) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(needles, arrow_type)], ["repo", "path", "text", "needles"]
            )

    found = files.select(F.lower("text").alias("low"), "repo", "path", "text").mapInArrow(
        scan, schema
    )
    return _lines_of(found)


def _join_many(
    files: DataFrame, usable: DataFrame, pairs: DataFrame | None = None, anchors: int = 3
) -> DataFrame:
    """Candidates by the rarest grams of each query, then the line test.

    What is small as a rule (the grams of the queries, the picked grams, the candidates) is
    measured and then broadcast, so neither postings nor texts are shuffled; where it is
    not small the joins shuffle.
    """
    query_grams = usable.select("query_id", F.explode(trigrams("needle")).alias("gram"))
    asked = broadcast_if_small(staged(query_grams.select("gram").distinct(), "query-grams"))
    used = (postings.gram_pairs(files) if pairs is None else pairs).join(asked, "gram", "left_semi")
    if pairs is None:
        used = staged(used, "used-pairs")  # texts are cut into grams once
    counts = postings.gram_counts(used)
    # A gram without postings counts as zero: it ranks first and matches nothing.
    rank = Window.partitionBy("query_id").orderBy("n_docs", "gram")
    ranked = (
        query_grams.join(counts, "gram", "left")
        .fillna(0, ["n_docs"])
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= anchors)
        .select("query_id", "gram", F.count("*").over(Window.partitionBy("query_id")).alias("need"))
    )
    picked = broadcast_if_small(staged(ranked, "picked-grams"))
    candidates = (
        used.join(picked, "gram")
        .groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("have"), F.first("need").alias("need"))
        .where(F.col("have") == F.col("need"))
        .select("query_id", "doc_id")
    )
    return candidate_lines(files, candidates, usable)


def candidate_lines(files: DataFrame, candidates: DataFrame, usable: DataFrame) -> DataFrame:
    """Line hits of the candidates (query_id, doc_id) of usable queries (query_id, needle).

    The needles of a document meet it as one list (with many queries a few lists), so a text
    is joined, lower-cased and cut into lines once, however many candidates it is in.
    """
    lists = usable.count() // NEEDLES + 1
    needles = (
        candidates.join(usable, "query_id")
        .groupBy("doc_id", F.pmod(F.xxhash64("query_id", "needle"), F.lit(lists)).alias("list"))
        .agg(F.collect_list(F.struct("query_id", "needle")).alias("needles"))
        .select("doc_id", "needles")
    )
    found = files.select("doc_id", "repo", "path", "text").join(
        broadcast_if_small(staged(needles, "candidates")), "doc_id"
    )
    held = _held_needles(needles.schema["needles"].dataType)(F.lower("text"), "needles")
    return _lines_of(found.select("repo", "path", "text", held.alias("needles")).where(F.size("needles") > 0))


def _held_needles(kind: T.ArrayType):
    """Column function of a lower-cased text and its needles: the needles that it holds.

    Plain substring search: a needle is mostly far longer than a word, and is found much
    faster by skipping than by Spark's test of every byte.
    """
    arrow_type = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def held(lows: pa.Array, lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten(), [0, *accumulate(lists.value_lengths().to_pylist())]
        needles = flat.field("needle")
        hits, sizes = [], [0]
        for row, low in enumerate(lows):  # a text at a time becomes a string
            low = low.as_py() or ""
            at = ends[row]
            of = needles.slice(at, ends[row + 1] - at).to_pylist()
            hits.extend(at + i for i, needle in enumerate(of) if needle in low)
            sizes.append(len(hits))
        found = flat.take(pa.array(hits, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found).cast(arrow_type)

    return held.asNondeterministic()  # else a filter on the result finds it a second time


def _lines_of(found: DataFrame) -> DataFrame:
    """(query_id, repo, path, line, text): the lines that hold a needle of their text."""
    return (
        found.select("repo", "path", "needles", F.posexplode(lines("text")).alias("pos", "raw"))
        .withColumn("low", F.lower("raw"))
        .select(
            "repo",
            "path",
            (F.col("pos") + 1).alias("line"),
            strip("raw").alias("text"),
            F.explode(F.filter("needles", lambda n: F.contains(F.col("low"), n["needle"]))).alias("n"),
        )
        .select("n.query_id", "repo", "path", "line", "text")
    )


def search_many_postings(
    pairs: DataFrame, files: DataFrame, queries: DataFrame, anchors: int = 3
) -> DataFrame:
    """:func:`search_many` over stored postings."""
    return _join_many(files, usable_queries(queries), pairs, anchors)
