"""Registered queries over a stored index: runs, rebuilds, lookups and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import content_hash
from ..functions.vectors import hashing_embedder
from ..operators import files as ops
from ..operators import postings, reports, search, symbols
from ..session import shared_folder
from ..sources import tables, tree
from ..sources.store import Store
from ..streaming import apply, debounce
from .file_queries import _HTML, html_table
from .index import apply_changes, index_repositories, rebuild, remove_files, search_store
from .registry import FILES, each_line, grams_of, lines_of, query, stripped, words
from .vector_index import build_vectors


def _store(spark, name: str) -> Store:
    return Store(spark, shared_folder(spark, f"{name}-{uuid.uuid4().hex[:12]}"))


_RUN = f"""{FILES}, {grams_of('files')}, g AS (SELECT doc_id, count(*) AS n FROM pairs GROUP BY doc_id)"""


@query(
    "index_run_stats",
    f"""WITH {_RUN} SELECT repo, count(*) AS files_indexed, CAST(0 AS BIGINT) AS files_removed,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_indexed, CAST(coalesce(sum(n), 0) AS BIGINT) AS gram_pairs
FROM files LEFT JOIN g USING (doc_id) GROUP BY repo""",
)
def index_run_stats(spark, folder):
    return index_repositories(_store(spark, "run"), tables.files(spark, folder)).drop("symbols_extracted")


@query(
    "rebuild_totals",
    f"""WITH {_RUN} SELECT count(*) AS files_indexed, CAST(0 AS BIGINT) AS files_removed,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_indexed, CAST(coalesce(sum(n), 0) AS BIGINT) AS gram_pairs
FROM files LEFT JOIN g USING (doc_id)""",
)
def rebuild_totals(spark, folder):
    store = _store(spark, "rebuild")
    _, totals = rebuild(store, f"{store.root}-new", tables.files(spark, folder))
    return reports.run_totals(totals).drop("symbols_extracted")


@query(
    "documents_with_repo",
    f"""WITH {FILES} SELECT doc_id, repo, path, '/repos/' || repo AS repo_path FROM files""",
)
def documents_with_repo(spark, folder):
    docs = ops.documents_of(tables.files(spark, folder))
    registry = docs.select("repo").distinct().withColumn("path", F.concat(F.lit("/repos/"), "repo"))
    return ops.documents_with_repo(docs, registry).select("doc_id", "repo", "path", "repo_path")


@query(
    "symbols_of_docs",
    f"""WITH s AS ({_HTML}) SELECT page_id AS doc_id, kind, ordinal AS line, name FROM s JOIN pages USING (page_id)
WHERE contains(url, 'example.net')""",
)
def symbols_of_docs(spark, folder):
    wanted = tables.html_files(spark, folder).where(F.contains("repo", F.lit("example.net")))
    return symbols.symbols_of_docs(html_table(spark, folder), wanted).select("doc_id", "kind", "line", "name")


_LINES = f"{FILES}, {lines_of('files')}, {each_line()}"


@query(
    "search_repo_top",
    f"""WITH {_LINES} SELECT repo, path, line, {stripped('raw')} AS text FROM line_rows
WHERE contains(raw, 'th') AND path LIKE '%.md' ORDER BY repo, path, line LIMIT 25""",
)
def search_repo_top(spark, folder):
    return search.search_repo(tables.files(spark, folder), "th", file_glob="*.md", max_results=25)


@query(
    "search_index",
    f"""WITH {_LINES} SELECT repo, path, line, {stripped('raw')} AS text FROM line_rows
WHERE contains(lower(raw), 'thtion')""",
)
def search_index(spark, folder):
    """A phrase in a stored and compacted index: postings, then the texts they point to."""
    store = _store(spark, "search")
    index_repositories(store, tables.files(spark, folder))
    found = search_store(store.compact(f"{store.root}-compact"), "thtion", max_results=None)
    return found.select("repo", "path", "line", "text")


@query(
    "pattern_rules",
    f"""WITH {lines_of('documents')}, {each_line(columns='doc_id')}
SELECT CAST(doc_id AS STRING) AS repo, CAST(4294967296 + line - 1 AS BIGINT) AS ord, {stripped('raw')} AS pattern
FROM line_rows WHERE {stripped('raw')} <> '' AND NOT starts_with({stripped('raw')}, '#')""",
)
def pattern_rules(spark, folder):
    """Every document read as the ignore file of a repo of its own."""
    docs = tables.table(spark, folder, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("repo"), F.lit(".gitignore").alias("path"), "text")
    return tree.pattern_table(files)


@query(
    "stream_apply",
    """WITH c AS (SELECT event_id, ts, concat('src', CAST(user_id % 20 AS STRING)) AS repo,
    concat('f', CAST(user_id AS STRING), '.py') AS path, event_type FROM events),
l AS (SELECT repo, path, arg_max(event_type, (ts, event_id)) AS kind FROM c GROUP BY ALL)
SELECT repo, path, sha256('text of ' || path) AS blob_sha FROM l WHERE kind <> 'error'
UNION ALL SELECT 'manual', 'notes.md', sha256('by hand')""",
)
def stream_apply(spark, folder):
    """Changes applied by a stream in two runs, with a change by hand between them."""
    store = _store(spark, "stream")
    source, checkpoint = f"{store.root}-events", f"{store.root}-checkpoint"
    changes = tables.changes(spark, folder).select(
        "repo", "path", "event_type", F.struct("ts", "event_id").alias("last_ts")
    )
    ends = changes.agg(F.min("last_ts.ts").alias("a"), F.max("last_ts.ts").alias("b")).first()
    earlier = F.col("last_ts.ts") < F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2)

    def contents(keys):
        return keys.select("repo", "path", F.concat(F.lit("text of "), "path").alias("text"))

    def run(rows):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).parquet(source)
        apply.drain(apply.apply_stream(stream, store, contents, checkpoint=checkpoint, trigger={"availableNow": True}))

    run(changes.where(earlier))
    by_hand = spark.createDataFrame([("manual", "notes.md", "by hand")], "repo string, path string, text string")
    apply_changes(store, by_hand, by_hand.select("repo", "path").limit(0))
    run(changes.where(~earlier))
    return store.documents().select("repo", "path", "blob_sha")


# --- removals, stored vectors, options ------------------------------------------------------------


@query(
    "removed_files",
    f"""WITH {FILES}, toxic AS (SELECT repo, path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT repo, path, 'live' AS state FROM (SELECT repo, path FROM files EXCEPT SELECT repo, path FROM toxic)
UNION ALL SELECT repo, path, 'removed' FROM toxic UNION ALL SELECT repo, concat(path, '.none'), 'unknown' FROM toxic""",
)
def removed_files(spark, folder):
    """What a removal of toxic files and of files that were never there says, and what is live after it."""
    store = _store(spark, "removals")
    files = tables.files(spark, folder)
    index_repositories(store, files)
    toxic = tables.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    gone = files.join(toxic, "doc_id", "left_semi").select("repo", "path")
    asked = gone.unionByName(gone.withColumn("path", F.concat("path", F.lit(".none"))))
    said = remove_files(store, asked).select("repo", "path", F.when(F.col("removed"), "removed").otherwise("unknown").alias("state"))
    return said.unionByName(store.documents().select("repo", "path", F.lit("live").alias("state")))


_REFUSED = "Thtion"


def _refusing_model():
    """Vectors of the wrong length for chunks that hold a certain word."""
    embed = hashing_embedder(32)
    return lambda texts: [v[:3] if _REFUSED in t else v for t, v in zip(texts, embed(texts))]


@query(
    "stored_vectors",
    f"""WITH {FILES}, {lines_of('files')}, chunk_rows AS (
  SELECT doc_id, array_to_string(l[s + 1:s + 100], chr(10)) AS content FROM (SELECT doc_id, l, unnest(range(0, len(l), 90)) AS s FROM ln)),
counted AS (SELECT doc_id, length(content) AS n, CAST({words('content')} AS DOUBLE) AS toks FROM chunk_rows),
sized AS (SELECT doc_id, n, toks, floor(greatest(1.0, n / toks) * 1024) - floor(greatest(1.0, n / toks) * 128) AS step FROM counted),
parts AS (SELECT doc_id, CAST(sum(CASE WHEN toks > 2048 THEN ceil(n / step) WHEN n > 12000 THEN ceil(n / 9000.0) ELSE 1 END) AS BIGINT) AS n
  FROM sized GROUP BY doc_id)
SELECT repo, path, CASE WHEN contains(text, '{_REFUSED}') THEN 0 ELSE coalesce(n, 0) END AS vectors,
  CASE WHEN contains(text, '{_REFUSED}') THEN 'vector_upsert_failed' END AS error
FROM files LEFT JOIN parts USING (doc_id)""",
)
def stored_vectors(spark, folder):
    """Vectors of each document read back from a store, and why documents have none."""
    store = _store(spark, "vectors")
    index_repositories(store, tables.files(spark, folder))
    build_vectors(store, _refusing_model, store.reserve("vectors"), dim=32)
    counts = store.live("vectors").groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"))
    return store.documents().join(counts, "doc_id", "left").select(
        "repo", "path", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.col("vector_index_error").alias("error")
    )


@query("allow_patterns", f"WITH {FILES} SELECT doc_id, NOT regexp_matches(path, '[.](py|pyw|pyi|ts|tsx)$') AS ignored FROM files")
def allow_patterns(spark, folder):
    """Everything is ignored but files of two languages."""
    patterns = ["*", *paths.allow_patterns(["python", "typescript"])]
    return tables.files(spark, folder).select("doc_id", paths.last_match("path", patterns).alias("ignored"))


@query(
    "wiped_postings",
    f"""WITH german AS (SELECT * FROM documents WHERE lang = 'de'), {grams_of('german')}
SELECT gram, count(*) AS n_docs FROM pairs GROUP BY gram""",
)
def wiped_postings(spark, folder):
    """Postings after a full wipe that only one language's documents were indexed again."""
    docs = tables.table(spark, folder, "documents")
    wiped = postings.empty_postings(postings.gram_pairs(docs))
    return postings.gram_counts(postings.merge_postings(wiped, postings.gram_pairs(docs.where("lang = 'de'"))))


@query(
    "watch_options",
    """WITH changes AS (SELECT event_id, user_id % 20 AS k, concat(CASE event_id % 3 WHEN 0 THEN 'docs/' WHEN 1 THEN 'app/' ELSE 'src/' END,
    'f', CAST(user_id AS STRING), '.py') AS path FROM events)
SELECT event_id, path FROM changes WHERE k NOT IN (4, 5)
  AND NOT (k % 2 = 0 AND starts_with(path, 'docs/') AND NOT starts_with(path, 'docs/f1'))""",
)
def watch_options(spark, folder):
    """Changes by each repo's own options: watched or not, patterns honoured or not."""
    events = tables.changes(spark, folder)
    top = F.when(F.col("event_id") % 3 == 0, "docs/").when(F.col("event_id") % 3 == 1, "app/").otherwise("src/")
    events = events.withColumn("path", F.concat(top, "path"))
    repos = events.select("repo").distinct()
    options = repos.select(
        "repo", (~F.col("repo").isin("src4", "src5")).alias("watch"), (F.substring("repo", 4, 9).cast("int") % 2 == 0).alias("respect_gitignore")
    )
    listed = F.array(F.lit("docs/"), F.lit("!docs/f1*"))
    patterns = repos.select("repo", F.posexplode(listed).alias("ord", "pattern"))
    return debounce.kept_by_repo(events, options, patterns).select("event_id", "path")


@query(
    "decoded_bytes",
    f"""WITH {FILES} SELECT repo, path, sha256(text || chr(65533)) AS text_sha, sha256(encode(text) || '\\xC3'::BLOB) AS blob_sha,
  CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size FROM files""",
)
def decoded_bytes(spark, folder):
    """Files whose last character is cut in the middle: text, hash and size follow from the bytes."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    files = ops.decoded(tables.files(spark, folder).select("repo", "path", raw.alias("content")))
    return files.select("repo", "path", content_hash("text").alias("text_sha"), "blob_sha", "size")
