"""Registered queries: search, postings, lines, chunks and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bitmaps, chunks, postings, search
from ..operators.ignore import embed_allowed
from ..functions.records import notebook_text
from ..operators.sizing import staged
from ..session import run_folder
from ..sources import tables
from .registry import (
    FILES,
    each_line,
    grams_of,
    lines_of,
    query,
    stripped,
    words,
)

PHRASE = "tion the"
_LINES = f"{FILES}, {lines_of('files')}, {each_line()}"
_HITS = f"""SELECT repo, path, line, {stripped('raw')} AS text, concat(repo, '::', path) AS doc_id
FROM line_rows WHERE contains(lower(raw), '{PHRASE}')"""


@query("search_code", f"WITH {_LINES} {_HITS}")
def search_code(spark, folder):
    return search.search_code(tables.files(spark, folder), PHRASE, max_results=None)


@query("search_code_top", f"WITH {_LINES} {_HITS} ORDER BY repo, path, line LIMIT 50")
def search_code_top(spark, folder):
    return search.search_code(tables.files(spark, folder), PHRASE)


@query("search_code_repo", f"WITH {_LINES} {_HITS} AND repo = 'src3' ORDER BY repo, path, line LIMIT 50")
def search_code_repo(spark, folder):
    return search.search_code(tables.files(spark, folder), PHRASE, repo="src3")


@query("search_code_postings", f"WITH {_LINES} {_HITS}")
def search_code_postings(spark, folder):
    files = tables.files(spark, folder)
    return search.search_postings(postings.gram_pairs(files), files, PHRASE, max_results=None)


_QUERIES = f"""{lines_of('benchmark', name='bl')},
needles AS (SELECT DISTINCT * FROM (
  SELECT concat(CAST(item_id AS STRING), ':', CAST(n AS STRING)) AS query_id, lower(q) AS needle
  FROM (SELECT item_id, unnest(l) AS q, unnest(range(1, len(l) + 1)) AS n FROM bl)) WHERE length(needle) >= 3)"""
_MANY = f"""WITH {_LINES}, {_QUERIES}
SELECT query_id, repo, path, line, {stripped('raw')} AS text
FROM line_rows JOIN needles ON contains(lower(raw), needle)"""


def benchmark_queries(spark, folder):
    """Every line of the benchmark texts as a query."""
    items = tables.table(spark, folder, "benchmark")
    return chunks.line_table(items, ("item_id",)).select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("line").cast("string")).alias("query_id"),
        F.col("text").alias("query"),
    )


@query("search_code_multi", _MANY)
def search_code_multi(spark, folder):
    return search.search_many(tables.files(spark, folder), benchmark_queries(spark, folder))


@query("search_code_multi_postings", _MANY)
def search_code_multi_postings(spark, folder):
    return search.search_many(
        tables.files(spark, folder), benchmark_queries(spark, folder), method="postings"
    )


def _bitmaps(spark, folder, files):
    """A bitmap index of the files, built anew below the shared folder."""
    pairs = staged(postings.gram_pairs(files), "gram-pairs")
    return bitmaps.build_bitmaps(pairs, run_folder(spark, "bitmaps"))


@query(
    "posting_bitmaps",
    f"""WITH {grams_of('documents')}, numbers AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM (SELECT DISTINCT doc_id FROM pairs))
SELECT gram, 1 + (number - 1) // {bitmaps.BUCKET} AS bucket, count(*) AS n_docs
FROM pairs JOIN numbers USING (doc_id) GROUP BY ALL""",
)
def posting_bitmaps(spark, folder):
    """Documents of each gram and bucket, counted on the stored bitmaps and lists."""
    return _bitmaps(spark, folder, tables.table(spark, folder, "documents")).sizes()


@query("search_bitmaps", _MANY)
def search_bitmaps(spark, folder):
    files = tables.files(spark, folder)
    return _bitmaps(spark, folder, files).search(files, benchmark_queries(spark, folder))


@query(
    "search_repo",
    f"""WITH {_LINES} SELECT repo, path, line, {stripped('raw')} AS text FROM line_rows
WHERE contains(raw, 'Thtion') AND path LIKE '%.md'""",
)
def search_repo(spark, folder):
    return search.search_repo(
        tables.files(spark, folder), "Thtion", file_glob="*.md", max_results=None
    )


@query(
    "search_ids",
    f"""WITH {_LINES} SELECT concat(repo, '::', path) AS id,
  concat(repo, ':', path, ' (line ', CAST(line AS STRING), ')') AS title,
  concat('corpus://repos/', repo, '::', path) AS url
FROM line_rows WHERE contains(raw, 'Erer')""",
)
def search_ids(spark, folder):
    return search.search_ids(tables.files(spark, folder), "Erer", max_results=None)


# --- postings -----------------------------------------------------------------------------------


@query(
    "trigram_postings",
    f"""WITH {grams_of('documents')}, placed AS (
  SELECT gram, doc_id, ((doc_id % 1000003) * 40503 // 256) % {postings.SEGMENTS} AS segment FROM pairs)
SELECT gram, segment, string_agg(CAST(doc_id AS STRING), ',' ORDER BY doc_id) AS doc_ids, count(*) AS n_docs
FROM placed GROUP BY gram, segment""",
)
def trigram_postings(spark, folder):
    docs = tables.table(spark, folder, "documents")
    lists = postings.posting_lists(postings.gram_pairs(docs))
    return lists.withColumn("doc_ids", F.array_join("doc_ids", ","))


@query(
    "trigram_top",
    f"""WITH {grams_of('documents')} SELECT gram, count(*) AS n_docs FROM pairs
GROUP BY gram ORDER BY n_docs DESC, gram LIMIT 20""",
)
def trigram_top(spark, folder):
    pairs = postings.gram_pairs(tables.table(spark, folder, "documents"))
    return postings.gram_counts(pairs).orderBy(F.desc("n_docs"), "gram").limit(20)


@query("trigram_total", f"WITH {grams_of('documents')} SELECT count(DISTINCT gram) AS trigrams FROM pairs")
def trigram_total(spark, folder):
    return postings.gram_total(postings.gram_pairs(tables.table(spark, folder, "documents")))


@query(
    "query_grams",
    f"WITH {grams_of('benchmark', key='item_id')} SELECT item_id, gram FROM pairs",
)
def query_grams(spark, folder):
    items = tables.table(spark, folder, "benchmark").withColumnRenamed("item_id", "doc_id")
    return postings.doc_grams(items).select(
        F.col("doc_id").alias("item_id"), F.explode("grams").alias("gram")
    )


@query(
    "posting_intersection",
    f"""WITH {grams_of('documents')}
SELECT doc_id FROM pairs WHERE gram IN ('tio', 'ion', 'on ', 'n t', ' th', 'the')
GROUP BY doc_id HAVING count(*) = 6""",
)
def posting_intersection(spark, folder):
    pairs = postings.gram_pairs(tables.table(spark, folder, "documents"))
    return postings.matching_docs(pairs, [PHRASE[i : i + 3] for i in range(len(PHRASE) - 2)])


@query(
    "posting_merge",
    f"""WITH {grams_of('documents')}, {grams_of('pages', 'page_id', 'html', 'page_pairs')},
both_pairs AS (SELECT gram, doc_id FROM pairs UNION SELECT gram, page_id FROM page_pairs)
SELECT gram, count(*) AS n_docs FROM both_pairs GROUP BY gram""",
)
def posting_merge(spark, folder):
    docs = postings.gram_pairs(tables.table(spark, folder, "documents"))
    pages = postings.gram_pairs(tables.html_files(spark, folder))
    return postings.gram_counts(postings.merge_postings(docs, pages))


@query(
    "posting_remove",
    f"""WITH {grams_of('documents')} SELECT gram, count(*) AS n_docs FROM pairs
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY gram""",
)
def posting_remove(spark, folder):
    pairs = postings.gram_pairs(tables.table(spark, folder, "documents"))
    toxic = tables.table(spark, folder, "labels").where("toxic = 1")
    return postings.gram_counts(postings.remove_docs(pairs, toxic))


@query(
    "stale_grams",
    f"""WITH edited AS (SELECT doc_id, replace(text, 'tion', 'sion') AS text FROM documents),
{grams_of('documents')}, {grams_of('edited', name='new_pairs')}
SELECT doc_id, gram FROM pairs EXCEPT SELECT doc_id, gram FROM new_pairs""",
)
def stale_grams(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    edited = docs.withColumn("text", F.replace("text", F.lit("tion"), F.lit("sion")))
    return postings.stale_grams(postings.gram_sets(docs), postings.gram_sets(edited))


# --- lines, chunks, windows -------------------------------------------------------------------------


@query(
    "lines",
    f"WITH {lines_of('documents')}, {each_line(columns='doc_id')} SELECT doc_id, line, raw AS text FROM line_rows",
)
def lines(spark, folder):
    return chunks.line_table(tables.table(spark, folder, "documents"))


def _chunks_sql(size: int, overlap: int) -> str:
    return f"""{lines_of('documents')}, chunk_rows AS (
  SELECT doc_id, CAST(s / {size - overlap} AS INTEGER) AS chunk_index, CAST(s + 1 AS INTEGER) AS start_line,
    CAST(least(s + {size}, len(l)) AS INTEGER) AS end_line,
    array_to_string(l[s + 1:s + {size}], chr(10)) AS content
  FROM (SELECT doc_id, l, unnest(range(0, len(l), {size - overlap})) AS s FROM ln))"""


@query("chunk_lines", f"WITH {_chunks_sql(20, 5)} SELECT * FROM chunk_rows")
def chunk_lines(spark, folder):
    return chunks.chunk_table(tables.table(spark, folder, "documents"), max_lines=20, overlap=5)


@query(
    "hard_wrap",
    """SELECT doc_id, CAST(s / 1800 AS INTEGER) AS idx, substring(text, s + 1, 2000) AS piece
FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS s FROM documents)""",
)
def hard_wrap(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(tx.hard_wrap("text", 2000, 200)).alias("idx", "piece"))


_LIMITS = dict(
    max_tokens=300, target_tokens=150, token_overlap=20, hard_chars=1200, hard_window=1000, hard_overlap=100
)


@query(
    "chunk_limits",
    f"""WITH {_chunks_sql(100, 10)},
counted AS (SELECT *, length(content) AS n, {words('content')} AS toks FROM chunk_rows),
sized AS (SELECT *,
    CASE WHEN toks > 300 THEN greatest(1, CAST(floor(greatest(1.0, n / CAST(toks AS DOUBLE)) * 150) AS BIGINT))
      WHEN n > 1200 THEN 1000 END AS win,
    CASE WHEN toks > 300 THEN CAST(floor(greatest(1.0, n / CAST(toks AS DOUBLE)) * 20) AS BIGINT)
      WHEN n > 1200 THEN 100 END AS ovl
  FROM counted),
windows AS (
  SELECT doc_id, chunk_index, start_line, end_line, 0 AS pos, content AS piece, false AS cut
  FROM sized WHERE win IS NULL
  UNION ALL
  SELECT doc_id, chunk_index, start_line, end_line, pos, substring(content, pos + 1, win), true
  FROM (SELECT *, unnest(range(0, n, greatest(1, win - ovl))) AS pos FROM sized WHERE win IS NOT NULL)),
placed AS (
  SELECT *, length(piece) - length(replace(piece, chr(10), '')) + 1 AS n_lines FROM windows),
started AS (
  SELECT *, start_line + coalesce(sum(n_lines) OVER (PARTITION BY doc_id, chunk_index ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM placed)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos) - 1 AS INTEGER) AS chunk_index,
  CAST(first_line AS INTEGER) AS start_line,
  CAST(CASE WHEN cut THEN first_line + n_lines - 1 ELSE end_line END AS INTEGER) AS end_line, piece AS content
FROM started""",
)
def chunk_limits(spark, folder):
    files = tables.files(spark, folder)
    return chunks.embedding_chunks(files, ("doc_id",), **_LIMITS)


@query(
    "hardwrap_report",
    f"""WITH {_chunks_sql(100, 10)},
counted AS (
  SELECT doc_id, count(*) AS total_chunks,
    count(*) FILTER (length(content) > 12000 OR (length(content) > 0 AND {words('content')} > 2048)) AS oversized_count
  FROM chunk_rows GROUP BY doc_id), {FILES}
SELECT repo, path, oversized_count, total_chunks FROM counted JOIN files USING (doc_id)
WHERE oversized_count > 0 ORDER BY oversized_count DESC, repo, path LIMIT 50""",
)
def hardwrap_report(spark, folder):
    return chunks.hard_wrap_report(tables.files(spark, folder), top_n=50)


@query(
    "token_counts",
    f"""SELECT doc_id, CAST({words('text')} AS INTEGER) AS words,
  CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS chars4 FROM documents""",
)
def token_counts(spark, folder):
    return tables.table(spark, folder, "documents").select(
        "doc_id",
        tx.token_count("text", "words").alias("words"),
        tx.token_count("text", "chars4").alias("chars4"),
    )


@query(
    "segments",
    """SELECT doc_id, 0 AS idx, text AS piece FROM documents WHERE length(text) <= 2048
UNION ALL
SELECT doc_id, CAST(s / 1536 AS INTEGER), substring(text, s + 1, 1536)
FROM (SELECT doc_id, text, unnest(range(0, length(text), 1536)) AS s FROM documents WHERE length(text) > 2048)""",
)
def segments(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(tx.segments("text", 512)).alias("idx", "piece"))


# --- records and notebooks ----------------------------------------------------------------------------


_RECORDS = """SELECT conv_id, turn, 0 AS record, CASE role
  WHEN 'user' THEN text
  WHEN 'assistant' THEN concat('assistant', chr(10), chr(10), '--SOLUTION--', chr(10), chr(10), text)
  ELSE text END AS content
FROM conversations"""


@query("jsonl_records", _RECORDS)
def jsonl_records(spark, folder):
    turns = tables.records(spark, folder).withColumnRenamed("record", "text")
    return chunks.record_table(turns, ("conv_id", "turn"))


@query("jsonl_records_exact", _RECORDS)
def jsonl_records_exact(spark, folder):
    turns = tables.records(spark, folder).withColumnRenamed("record", "text")
    return chunks.record_table(turns, ("conv_id", "turn"), exact=True)


@query(
    "notebook_text",
    """SELECT conv_id, turn, concat('# ', role, chr(10), chr(10), text) AS text FROM conversations""",
)
def notebooks(spark, folder):
    cell = lambda kind, *source: F.struct(
        F.lit(kind).alias("cell_type"), F.array(*source).alias("source")
    )
    turns = tables.table(spark, folder, "conversations")
    book = F.to_json(
        F.struct(
            F.array(
                cell("markdown", F.lit("# "), F.col("role")),
                cell("raw", F.lit("not kept")),
                cell("code", F.lit(" ")),
                cell("code", F.col("text")),
            ).alias("cells"),
            F.lit(4).alias("nbformat"),
        )
    )
    return turns.select("conv_id", "turn", notebook_text(book).alias("text"))


@query(
    "embed_policy",
    f"""WITH {FILES}, {lines_of('files')}
SELECT doc_id, NOT (regexp_matches(path, '\\.log$') AND len(list_filter(l, lambda x: length(x) > 10000)) > 0) AS allowed
FROM ln""",
)
def embed_policy(spark, folder):
    """Logs are read as JSONL here, so that the long line rule has something to judge."""
    files = tables.files(spark, folder)
    named = files.withColumn("path", F.regexp_replace("path", r"\.log$", ".jsonl.txt"))
    return named.select("doc_id", embed_allowed().alias("allowed"))
