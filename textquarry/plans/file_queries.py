"""Registered queries: file rules, listing, reading, blobs, changes, symbols and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths, redact
from ..functions.classify import classify
from ..functions.text import content_hash
from ..functions.text import lines as text_lines
from ..operators import files as ops
from ..operators import braces, ignore, pages, postings, reports, rule_index, symbols
from ..session import run_folder, shared_folder
from ..sources import tables, tail, tree
from ..sources.store import Store
from ..streaming.apply import drain
from ..streaming.listings import CHANGES, Listings
from .index import apply_changes, index_repositories
from .registry import FILES, each_line, grams_of, head_bytes, lines_of, query, stripped

_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _case(table) -> str:
    return " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, exts in table.items() for e in exts)


# --- languages and classes ----------------------------------------------------------------------


@query(
    "doc_language",
    f"""WITH {FILES} SELECT doc_id, CASE {_EXT} {_case(fixed.DOCUMENT_LANGUAGES)} ELSE 'unknown' END AS language
FROM files""",
)
def doc_language(spark, folder):
    return tables.files(spark, folder).select("doc_id", paths.language_of("path").alias("language"))


_EDGE = r"(^|[^\p{L}\p{N}_])"
_END = r"($|[^\p{L}\p{N}_])"


@query(
    "classify_path",
    f"""WITH {FILES}, e AS (SELECT *, {_EXT} AS ext FROM files),
probes AS (SELECT *,
  list_has_any(string_split(path, '/'), {list(fixed.ARTIFACT_DIRS)}) AS artifact,
  regexp_matches(text, '^\\s*#!')
    OR regexp_matches(text, '{_EDGE}(class|def|function|package|namespace|public\\s+static\\s+void){_END}')
    OR (length(text) - length(replace(text, ';', '')) > 3
      AND 2 * length(text) - length(replace(text, '{{', '')) - length(replace(text, '}}', '')) > 1) AS codelike,
  regexp_matches(text, '@interface|@implementation|@class{_END}') AS objc,
  regexp_matches(text, '{_EDGE}namespace{_END}|{_EDGE}std::|{_EDGE}template\\s*<') AS cpp
  FROM e),
flags AS (SELECT *,
  CASE WHEN ext = '' THEN codelike WHEN artifact THEN false
    ELSE ext IN {_in(fixed.CODE_EXTENSIONS)} AND ext NOT IN {_in(fixed.DOC_EXTENSIONS + fixed.DATA_EXTENSIONS)} END AS is_code
  FROM probes)
SELECT doc_id, is_code, NOT artifact AND ext IN {_in(fixed.DOC_EXTENSIONS)} AS is_doc,
  NOT artifact AND ext IN {_in(fixed.CONFIG_EXTENSIONS)} AS is_config,
  artifact OR ext IN {_in(fixed.DATA_EXTENSIONS)} AS is_data,
  nullif(ext, '') AS extension,
  CASE WHEN ext = '' THEN CASE WHEN is_code THEN NULL ELSE 'unknown' END
    WHEN ext = '.h' THEN CASE WHEN objc THEN 'objective-c' WHEN cpp THEN 'cpp' ELSE 'c' END
    ELSE CASE ext {_case(fixed.CHUNK_LANGUAGES)} ELSE 'unknown' END END AS language
FROM flags""",
)
def classify_path(spark, folder):
    files = tables.files(spark, folder)
    return files.select("doc_id", classify("path", "text").alias("c")).select("doc_id", "c.*")


# --- ignore rules ----------------------------------------------------------------------------------

_RULES = dict(
    repo_patterns=["!fr/build/*", "es/build/"],
    global_patterns=["# comment", "!de/*.md", "*9.md"],
    gitignore=["*.csv", "!en/*", "/de/doc_1*"],
    skip_dirs=fixed.INDEX_SKIP_DIRS,
    skip_extensions=(".log",),
    max_size=20_000,
)
_DECISION = f"""CASE
  WHEN path LIKE 'fr/build/%' THEN 'repo_allow'
  WHEN path LIKE 'es/build/%' THEN 'repo_ignore'
  WHEN path LIKE 'de/%.md' THEN 'global_allow'
  WHEN path LIKE '%9.md' THEN 'global_ignore'
  WHEN path LIKE '%/build/%' THEN 'dir'
  WHEN {_EXT} = '.log' THEN 'extension'
  WHEN octet_length(encode(text)) > 20000 THEN 'size'
  WHEN path LIKE 'de/doc\\_1%' ESCAPE '\\' THEN 'gitignore'
  WHEN path LIKE 'en/%' THEN 'keep'
  WHEN path LIKE '%.csv' THEN 'gitignore'
  ELSE 'keep' END"""
_DECIDED = f"""{FILES}, decided AS (
  SELECT doc_id, repo, path, {_DECISION} AS reason FROM files),
judged AS (SELECT *, reason NOT IN ('keep', 'repo_allow', 'global_allow') AS ignored FROM decided)"""


def _decided(spark, folder):
    files = tables.files(spark, folder).withColumn("size", F.octet_length("text"))
    return ignore.with_decision(files, **_RULES)


@query("ignore_decision", f"WITH {_DECIDED} SELECT doc_id, ignored, reason FROM judged")
def ignore_decision(spark, folder):
    return _decided(spark, folder).select("doc_id", "ignored", "reason")


@query(
    "ignore_decision_table",
    f"""WITH {FILES}
SELECT doc_id, CASE WHEN path LIKE '%.md' AND repo IN ('src1', 'src2') THEN 'include'
  WHEN path LIKE '%.csv' AND NOT path LIKE concat('%', substr(repo, 4), '.csv') THEN 'gitignore'
  WHEN path LIKE concat('%', substr(repo, 4), '.log') THEN 'gitignore' ELSE 'keep' END AS reason
FROM files""",
)
def ignore_decision_table(spark, folder):
    """Each repo brings its own pattern list, derived from its name."""
    files = tables.files(spark, folder).withColumn("size", F.lit(0))
    repos = files.select("repo").distinct()
    number = F.substring("repo", 4, 10)
    listed = F.array(
        F.lit("*.csv"), F.concat(F.lit("!*"), number, F.lit(".csv")), F.concat(F.lit("*"), number, F.lit(".log"))
    )
    git = repos.select("repo", F.posexplode(listed).alias("ord", "pattern"))
    include = repos.where(F.col("repo").isin("src1", "src2")).select(
        "repo", F.lit(0).alias("ord"), F.lit("*.md").alias("pattern")
    )
    return ignore.with_table_decision(files, git, include).select("doc_id", "reason")


_RULE_REPOS = 20  # of the rule table
_RULE_KIND = "(doc_id + k) % 10"
_RULE_TABLE = f"""numbered AS (SELECT doc_id, lang, unnest(range(0, {_RULE_REPOS})) AS k FROM documents),
rules AS (SELECT concat('src', CAST(k AS STRING)) AS repo, doc_id AS ord, {_RULE_KIND} AS kind,
    CASE {_RULE_KIND} WHEN 0 THEN concat(lang, '/doc_', CAST(doc_id AS STRING), '.py')
      WHEN 1 THEN concat('doc_', CAST(doc_id AS STRING), '.md') WHEN 2 THEN concat('doc_', CAST(doc_id AS STRING), '.json')
      WHEN 3 THEN CASE WHEN doc_id % 100 = 3 THEN '.ts' ELSE concat('.x', CAST(doc_id AS STRING)) END
      WHEN 4 THEN concat('build/doc_', CAST(doc_id AS STRING), '.csv') WHEN 5 THEN concat(lang, '/build')
      WHEN 6 THEN concat('doc_', CAST(doc_id AS STRING), '.h') WHEN 7 THEN 'build'
      ELSE concat('doc_', CAST(doc_id AS STRING)) END AS core FROM numbered WHERE doc_id IS NOT NULL)"""


def _rule_table(spark, folder):
    """A rule for each document and each of 20 repos: paths, names, endings, directories and, a
    few, true globs, some of them negated."""
    docs = tables.table(spark, folder, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang")
    docs = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_RULE_REPOS - 1))))
    kind = F.expr(_RULE_KIND)
    of = lambda *parts: F.concat(*(F.lit(p) if p != "lang" else F.col("lang") for p in parts[:-1]), F.col("doc_id").cast("string"), F.lit(parts[-1]))
    pattern = (
        F.when(kind == 0, of("/", "lang", "/doc_", ".py"))
        .when(kind == 1, of("doc_", ".md"))
        .when(kind == 2, of("!doc_", ".json"))
        .when(kind == 3, F.when(F.col("doc_id") % 100 == 3, "*.ts").otherwise(of("*.x", "")))
        .when(kind == 4, of("build/doc_", ".csv"))
        .when(kind == 5, F.concat(F.lit("!"), F.col("lang"), F.lit("/build/")))
        .when(kind == 6, of("**/doc_", ".h"))
        .when(kind == 7, F.lit("build/*"))
        .when((kind == 8) & (F.col("doc_id") % 500 == 8), of("?[!x]/doc_", "*.*"))
        .when(kind == 8, of("doc_", "/"))
        .otherwise(of("!/doc_", ""))
    )
    return docs.select(F.concat(F.lit("src"), F.col("k").cast("string")).alias("repo"), F.col("doc_id").alias("ord"), pattern.alias("pattern"))


@query(
    "ignore_rule_index",
    f"""WITH {FILES}, {_RULE_TABLE}, names AS (SELECT doc_id, repo, path, regexp_extract(path, '[^/]*$') AS name FROM files),
hits AS (SELECT f.doc_id, r.ord, kind IN (2, 5, 9) AS negated FROM names f JOIN rules r ON f.repo = r.repo AND CASE
    WHEN kind = 0 THEN path = core OR name = core
    WHEN kind IN (1, 2, 4) THEN path = core OR ends_with(path, '/' || core)
    WHEN kind = 3 THEN ends_with(path, core)
    WHEN kind = 5 THEN path = core OR starts_with(path, core || '/') OR ends_with(path, '/' || core)
    WHEN kind = 6 THEN ends_with(path, '/' || core)
    WHEN kind = 7 THEN starts_with(path, 'build/') OR contains(path, '/build/')
    WHEN kind = 8 AND r.ord % 500 = 8 THEN regexp_matches(path, '(?s)^(.*/)?.[^x]/' || core || '.*[.].*$')
    WHEN kind = 8 THEN path = core OR starts_with(path, core || '/') OR ends_with(path, '/' || core)
    ELSE path = core OR name = core END),
last AS (SELECT doc_id, max(ord) AS ord, arg_max(negated, ord) AS negated FROM hits GROUP BY doc_id)
SELECT f.doc_id, coalesce(NOT negated, false) AS ignored, ord FROM files f LEFT JOIN last USING (doc_id)""",
)
def ignore_rule_index(spark, folder):
    """The last of a thousand rules and more of its repo that matches each file."""
    files = tables.files(spark, folder).select("doc_id", "repo", "path")
    last = rule_index.last_rule(files, _rule_table(spark, folder))
    return files.join(last, ["repo", "path"], "left").select(
        "doc_id", F.coalesce(~F.col("negated"), F.lit(False)).alias("ignored"), "ord"
    )


@query("scan_summary", f"""WITH {_DECIDED}, c AS (
  SELECT count(*) AS scanned, count(*) FILTER (ignored) AS skipped, count(*) FILTER (NOT ignored) AS included FROM judged)
SELECT scanned, skipped, included, (SELECT string_agg(p, ' ' ORDER BY p) FROM (
  SELECT concat(repo, '::', path) AS p FROM judged WHERE ignored ORDER BY p LIMIT 10)) AS skipped_examples FROM c""")
def scan_summary(spark, folder):
    out = reports.scan_summary(_decided(spark, folder))
    return out.withColumn("skipped_examples", F.array_join("skipped_examples", " "))


@query("skip_reasons", f"WITH {_DECIDED} SELECT reason, ignored, count(*) AS files FROM judged GROUP BY reason, ignored")
def skip_reasons(spark, folder):
    return reports.skip_reasons(_decided(spark, folder))


_GLOBS = ["*.md", "/en/*", "build/", "doc_[1-3]?.*", "en/", "!*.csv"]


@query(
    "glob_match",
    rf"""WITH {FILES} SELECT doc_id, path LIKE '%.md' AS p0, path LIKE 'en/%' AS p1, false AS p2,
  regexp_matches(path, '(^|/)doc_[1-3].\.') AS p3, path LIKE 'en/%' AS p4,
  NOT path LIKE '%.csv' AND (path LIKE '%.md' OR path LIKE 'en/%') AS listed,
  path LIKE '%/build/%' AS strict_dir, path LIKE 'en/%.md' AND path NOT LIKE 'en/%/%' AS find_md
FROM files""",
)
def glob_match(spark, folder):
    files = tables.files(spark, folder)
    columns = [paths.pattern_match("path", g).alias(f"p{i}") for i, g in enumerate(_GLOBS[:5])]
    return files.select(
        "doc_id",
        *columns,
        paths.last_match("path", ["*.md", "/en/*", "!*.csv"]).alias("listed"),
        paths.pattern_match("path", "build/", strict=True).alias("strict_dir"),
        paths.find_match("path", "en/*.md").alias("find_md"),
    )


@query(
    "contain_paths",
    f"""WITH {FILES} SELECT doc_id, path AS clean FROM files WHERE path NOT LIKE 'fr/%'""",
)
def contain_paths(spark, folder):
    files = tables.files(spark, folder)
    odd = F.when(
        F.startswith("path", F.lit("fr/")), F.concat(F.lit("a/../../"), F.col("path"))
    ).otherwise(F.concat(F.lit("./x/../"), F.col("path"), F.lit("/.")))
    return ignore.contained(files.withColumn("clean", odd), "clean").select("doc_id", "clean")


# --- listing and reading -----------------------------------------------------------------------------

_ENTRIES = f"""WITH {FILES}, parts AS (SELECT repo, path, string_split(path, '/') AS p FROM files),
entries AS (
  SELECT DISTINCT 'dir' AS type, repo, array_to_string(p[1:n], '/') AS path
  FROM (SELECT repo, p, unnest(range(1, len(p))) AS n FROM parts)
  UNION ALL SELECT 'file', repo, path FROM parts)
SELECT type, repo, path FROM entries"""


@query("list_repo_files", _ENTRIES)
def list_repo_files(spark, folder):
    return ops.list_entries(tables.files(spark, folder), max_entries=None)


@query("list_repo_files_top", f"{_ENTRIES} WHERE repo = 'src7' ORDER BY type, repo, path LIMIT 30")
def list_repo_files_top(spark, folder):
    return ops.list_entries(tables.files(spark, folder), repo="src7", max_entries=30)


_REPOS = "SELECT source AS repo, concat('/data/', source) AS path FROM documents GROUP BY source"


def _repos(spark, folder):
    sources = tables.table(spark, folder, "documents").select(F.col("source").alias("repo")).distinct()
    return sources.withColumn("path", F.concat(F.lit("/data/"), F.col("repo")))


@query("list_repos", f"{_REPOS} ORDER BY repo")
def list_repos(spark, folder):
    return ops.list_repos(_repos(spark, folder))


@query(
    "repo_upsert",
    f"""WITH old AS ({_REPOS}), fresh AS (
  SELECT DISTINCT source AS repo, concat('/moved/', source) AS path FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '/web' FROM pages)
SELECT coalesce(f.repo, o.repo) AS repo, coalesce(f.path, o.path) AS path FROM old o FULL JOIN fresh f ON o.repo = f.repo""",
)
def repo_upsert(spark, folder):
    toxic = tables.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    moved = (
        tables.files(spark, folder)
        .join(toxic, "doc_id", "left_semi")
        .select("repo")
        .distinct()
        .withColumn("path", F.concat(F.lit("/moved/"), F.col("repo")))
    )
    hosts = tables.html_files(spark, folder).select("repo").distinct().withColumn("path", F.lit("/web"))
    return ops.upsert_repos(_repos(spark, folder), moved.unionByName(hosts))


@query("read_file", f"WITH {FILES} SELECT repo, path, {head_bytes('text', 2000)} AS text FROM files")
def read_file(spark, folder):
    return ops.read_files(tables.files(spark, folder), max_bytes=2000)


@query(
    "fetch",
    f"""WITH {FILES} SELECT concat(repo, '::', path) AS id, concat(repo, ':', path) AS title,
  {head_bytes('text', 50000)} AS text, concat('corpus://repos/', repo, '::', path) AS url, repo, path
FROM files WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def fetch(spark, folder):
    files = tables.files(spark, folder)
    labelled = tables.table(spark, folder, "labels").select("doc_id")
    ids = files.join(labelled, "doc_id", "left_semi").select(paths.hit_id("repo", "path").alias("id"))
    return ops.fetch(files, ids).select("id", "title", "text", "url", "metadata.*")


# --- blobs and changes -----------------------------------------------------------------------------------


@query("blob_dedup", "SELECT DISTINCT sha256(text) AS blob_sha, text FROM documents")
def blob_dedup(spark, folder):
    return ops.blobs_of(tables.files(spark, folder))


@query("blob_refs", "SELECT sha256(text) AS blob_sha, count(*) AS refs FROM documents GROUP BY 1")
def blob_refs(spark, folder):
    return ops.blob_refs(ops.documents_of(tables.files(spark, folder)))


_TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"


@query(
    "blob_orphans",
    f"""SELECT DISTINCT sha256(text) AS blob_sha FROM documents WHERE sha256(text) NOT IN (
  SELECT sha256(text) FROM documents WHERE doc_id NOT IN ({_TOXIC}))""",
)
def blob_orphans(spark, folder):
    files = tables.files(spark, folder)
    toxic = tables.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    kept = ops.documents_of(files.join(toxic, "doc_id", "left_anti"))
    return ops.orphan_blobs(ops.blobs_of(files), kept).select("blob_sha")


_NEXT = f"""{FILES}, next_files AS (
  SELECT f.repo, f.path, CASE WHEN l.quality = 0 THEN concat(f.text, chr(10), 'edited') ELSE f.text END AS text
  FROM files f LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS DISTINCT FROM 1
  UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1),
    regexp_replace(url, '^[a-z]+://[^/?#]+/?', ''), html FROM pages)"""


def next_files(spark, folder):
    """A later state of the corpus: toxic documents gone, poor ones edited, web pages added."""
    labels = tables.table(spark, folder, "labels")
    later = (
        tables.files(spark, folder)
        .join(labels, "doc_id", "left")
        .where(~F.col("toxic").eqNullSafe(1))
        .withColumn(
            "text",
            F.when(F.col("quality") == 0, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text")),
        )
    )
    keep = ["repo", "path", "text"]
    return later.select(*keep).unionByName(tables.html_files(spark, folder).select(*keep))


@query(
    "blob_new",
    f"""WITH {_NEXT} SELECT DISTINCT sha256(text) AS blob_sha FROM next_files
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)""",
)
def blob_new(spark, folder):
    stored = ops.blobs_of(tables.files(spark, folder))
    return ops.new_blobs(ops.blobs_of(next_files(spark, folder)), stored).select("blob_sha")


@query(
    "change_detect",
    f"""WITH {_NEXT} SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
    WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'changed' END AS change
FROM files o FULL JOIN next_files n ON o.repo = n.repo AND o.path = n.path""",
)
def change_detect(spark, folder):
    old = ops.documents_of(tables.files(spark, folder))
    return ops.detect_changes(old, ops.documents_of(next_files(spark, folder)))


@query(
    "change_stream",
    f"""WITH {_NEXT} SELECT 0 AS snapshot, repo, path, 'created' AS event_type FROM files
UNION ALL SELECT 1, coalesce(o.repo, n.repo), coalesce(o.path, n.path), CASE WHEN o.path IS NULL THEN 'created'
  WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END
FROM files o FULL JOIN next_files n ON o.repo = n.repo AND o.path = n.path WHERE sha256(o.text) IS DISTINCT FROM sha256(n.text)""",
)
def change_stream(spark, folder):
    """Changes that a stream reads from two recorded listings, the second recorded while the
    stream's checkpoint stands behind the first."""
    base = run_folder(spark, "listings")
    listings = Listings(spark, f"{base}/listings")
    for state in (tables.files(spark, folder), next_files(spark, folder)):
        listings.record(ops.documents_of(state))
        drain(
            listings.stream().writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
    out = spark.read.schema(CHANGES).parquet(f"{base}/out")
    return out.select("snapshot", "repo", "path", "event_type")


@query(
    "documents_write",
    f"""WITH {_NEXT} SELECT repo, path, sha256(text) AS blob_sha FROM next_files
UNION ALL SELECT f.repo, f.path, sha256(f.text) FROM files f ANTI JOIN next_files n ON f.repo = n.repo AND f.path = n.path""",
)
def documents_write(spark, folder):
    old = ops.documents_of(tables.files(spark, folder))
    new = ops.documents_of(next_files(spark, folder))
    return ops.replace_rows(old, new).select("repo", "path", "blob_sha")


@query(
    "incremental_apply",
    f"""WITH {_NEXT}, {grams_of('next_files', 'repo, path')}
SELECT repo, path, sha256(n.text) AS blob_sha, count(gram) AS grams
FROM next_files n LEFT JOIN pairs USING (repo, path) GROUP BY repo, path, n.text""",
)
def incremental_apply(spark, folder):
    """Index the corpus, bring the index to the later state, and read it back."""
    store = Store(spark, shared_folder(spark, f"incremental-{_run_id()}"))
    index_repositories(store, tables.files(spark, folder))
    later = next_files(spark, folder)
    gone = tables.files(spark, folder).join(later, ["repo", "path"], "left_anti")
    apply_changes(store, later, gone)
    grams = store.live("postings").groupBy("doc_id").agg(F.count("*").alias("grams"))
    docs = store.documents().join(grams, "doc_id", "left")
    return docs.select("repo", "path", "blob_sha", F.coalesce("grams", F.lit(0)).alias("grams"))


def _run_id() -> str:
    import uuid

    return uuid.uuid4().hex[:12]


# --- symbols ------------------------------------------------------------------------------------------------

_HTML = "SELECT page_id, kind, CAST(ordinal AS INTEGER) AS ordinal, name FROM (" + " UNION ALL ".join(
    f"""SELECT page_id, '{kind}' AS kind, unnest(range(1, len(f) + 1)) AS ordinal,
    trim(regexp_replace(unnest(f), '<[^>]*>', '', 'g')) AS name
  FROM (SELECT page_id, regexp_extract_all(html, '{regex.replace("'", "''")}', 1) AS f FROM pages)"""
    for kind, regex in symbols.HTML_RULES
) + ") WHERE length(name) > 0"
_HOSTS = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_RESTS = "regexp_replace(url, '^[a-z]+://[^/?#]+/?', '')"


def html_table(spark, folder):
    """Symbols of the pages in the shape of a symbol table."""
    found = symbols.html_symbols(tables.table(spark, folder, "pages"))
    empty = F.lit(None).cast("string")
    return found.select(
        F.col("page_id").alias("doc_id"),
        "name",
        "kind",
        F.col("ordinal").alias("line"),
        empty.alias("signature"),
        empty.alias("scope"),
    )


@query("symbols_html", _HTML)
def symbols_html(spark, folder):
    return symbols.html_symbols(tables.table(spark, folder, "pages"))


@query(
    "find_symbol",
    f"""WITH s AS ({_HTML}) SELECT name, kind, concat({_HOSTS}, '::', {_RESTS}) AS file_path, ordinal AS line
FROM s JOIN pages USING (page_id) WHERE name = 't' AND kind = 'variable'""",
)
def find_symbol(spark, folder):
    pages = tables.html_files(spark, folder)
    found = symbols.find_symbol(html_table(spark, folder), pages, "t", kind="variable")
    return found.drop("signature", "scope")


@query(
    "list_symbols",
    f"""WITH s AS ({_HTML}) SELECT name, kind, concat({_HOSTS}, '::', {_RESTS}) AS file_path, ordinal AS line
FROM s JOIN pages USING (page_id)""",
)
def list_symbols(spark, folder):
    pages = tables.html_files(spark, folder)
    return symbols.list_symbols(html_table(spark, folder), pages).drop("signature", "scope")


@query(
    "markdown_symbols",
    f"""WITH {lines_of('documents')}, {each_line(columns='doc_id')},
heads AS (SELECT doc_id, line, (line - 1) % 4 AS level, regexp_replace({stripped('raw')}, '\\s*#*$', '') AS name
  FROM line_rows)
SELECT doc_id, name, CASE level WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' ELSE 'subsection' END AS kind, line
FROM heads WHERE level < 3 AND regexp_matches(name, '^[A-Za-z]') AND regexp_matches(name, '[.]$')""",
)
def markdown_symbols(spark, folder):
    """Outline of Markdown spelled from the documents: every line is a heading of level one
    to three in turn, or plain text. Only lines that begin with a letter and end with a full
    stop are asked for."""
    heads = F.transform(
        text_lines("text"), lambda x, i: F.concat(F.substring("marks", (i % 4) * 4 + 1, F.lit(4)), x)
    )
    sources = (
        tables.files(spark, folder)
        .withColumn("marks", F.lit("#   ##  ### ...."))
        .select("doc_id", "path", F.array_join(heads, "\n").alias("text"))
    )
    found = symbols.extract_symbols(sources, language=F.lit("markdown"))
    return found.where(F.rlike("name", F.lit(r"^[A-Za-z]")) & F.endswith("name", F.lit("."))).select(
        "doc_id", "name", "kind", "line"
    )


@query(
    "code_symbols",
    f"""WITH {lines_of('documents')}, {each_line(columns='doc_id')},
code AS (SELECT doc_id, line, regexp_extract(raw, '[A-Za-z]+') AS name,
  CASE WHEN line % 3 = 1 THEN regexp_extract(raw, '[A-Za-z]+') END AS owner FROM line_rows),
named AS (SELECT *, last_value(owner IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope FROM code WHERE name <> '')
SELECT doc_id, name, line, CASE WHEN owner IS NOT NULL THEN 'class' WHEN scope IS NULL THEN 'function' ELSE 'member' END AS kind,
  CASE WHEN owner IS NULL THEN '(self, x)' END AS signature, CASE WHEN owner IS NULL THEN scope END AS scope
FROM named""",
)
def code_symbols(spark, folder):
    """Definitions in Python sources spelled from the documents: the first word of every
    line names a class (each third line) or a function of the class above it."""
    word = lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)
    code = F.transform(
        text_lines("text"),
        lambda x, i: F.when(word(x) == "", "pass")
        .when(i % 3 == 0, F.concat(F.lit("class "), word(x), F.lit(":")))
        .otherwise(F.concat(F.lit("    def "), word(x), F.lit("(self, x):"))),
    )
    sources = tables.files(spark, folder).select(
        "doc_id", "path", F.array_join(code, "\n").alias("text")
    )
    return symbols.extract_symbols(sources, language=F.lit("python"))


_NO_METHOD = "'if', 'for', 'while', 'switch', 'catch', 'return', 'function'"


@query(
    "brace_symbols",
    f"""WITH {lines_of('documents')}, {each_line(columns='doc_id')},
code AS (SELECT doc_id, line - 1 AS i, nullif(regexp_extract(raw, '[A-Za-z]+'), '') AS name FROM line_rows),
placed AS (SELECT *, 1 + coalesce(sum(CASE WHEN i % 3 = 1 AND name IS NOT NULL THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, lag(name) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM code)
SELECT doc_id, name, 'class' AS kind, CAST(line AS INTEGER) AS line, NULL AS signature, NULL AS scope FROM placed
WHERE i % 3 = 0 AND name IS NOT NULL
UNION ALL SELECT doc_id, name, 'method', CAST(line AS INTEGER), '( x)', above FROM placed
WHERE i % 3 = 1 AND name IS NOT NULL AND above IS NOT NULL AND name NOT IN ({_NO_METHOD})""",
)
def brace_symbols(spark, folder):
    """Definitions in TypeScript sources spelled from the documents: of every three lines the
    first opens a class, the second is a method over two lines, with a brace in a string, and
    the third closes the class. A line without a word is a comment that holds a brace."""
    word = lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)
    code = F.transform(
        text_lines("text"),
        lambda x, i: F.when(i % 3 == 2, "}")
        .when(word(x) == "", "// {")
        .when(i % 3 == 0, F.concat(F.lit("class "), word(x), F.lit(" {")))
        .otherwise(F.concat(F.lit("  "), word(x), F.lit("(\n    x) { return '}' }"))),
    )
    sources = tables.files(spark, folder).select("doc_id", F.array_join(code, "\n").alias("text"))
    return braces.brace_symbols(sources, language=F.lit("typescript"))


@query(
    "symbol_orphans",
    f"""WITH s AS ({_HTML}), docs AS (SELECT page_id, {_HOSTS} AS repo, {_RESTS} AS path FROM pages WHERE NOT contains(url, '?')),
repos AS (SELECT {_HOSTS} AS repo FROM pages WHERE starts_with(url, 'https') GROUP BY 1)
SELECT 'document' AS kind, concat(repo, '::', path) AS key FROM docs ANTI JOIN repos USING (repo)
UNION ALL SELECT 'symbol', concat(CAST(page_id AS STRING), ':', name, ':', CAST(ordinal AS STRING))
FROM s ANTI JOIN docs USING (page_id)""",
)
def symbol_orphans(spark, folder):
    urls = tables.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    pages = tables.html_files(spark, folder).drop("text").join(urls, "doc_id")
    docs = pages.where(~F.contains("url", F.lit("?")))
    repos = pages.where(F.startswith("url", F.lit("https"))).select("repo").distinct()
    return reports.orphans(docs, repos, html_table(spark, folder))


# --- reports -------------------------------------------------------------------------------------------------


@query(
    "index_stats",
    f"""WITH {grams_of('pages', 'page_id', 'html')}, s AS ({_HTML})
SELECT (SELECT count(DISTINCT {_HOSTS}) FROM pages) AS repositories, (SELECT count(*) FROM pages) AS documents,
  (SELECT count(*) FROM s) AS symbols, (SELECT count(DISTINCT gram) FROM pairs) AS trigrams""",
)
def index_stats(spark, folder):
    pages = tables.html_files(spark, folder)
    repos = pages.select("repo").distinct()
    return reports.index_stats(repos, pages, html_table(spark, folder), postings.gram_pairs(pages))


@query(
    "repo_index_stats",
    f"""WITH s AS ({_HTML}), n AS (SELECT page_id, count(*) AS c FROM s GROUP BY page_id)
SELECT {_HOSTS} AS repo, count(*) AS documents, CAST(coalesce(sum(c), 0) AS BIGINT) AS symbols, '2024-01-01' AS indexed_at
FROM pages LEFT JOIN n USING (page_id) GROUP BY 1""",
)
def repo_index_stats(spark, folder):
    pages = tables.html_files(spark, folder)
    repos = pages.select("repo", F.lit("2024-01-01").alias("indexed_at")).distinct()
    return reports.repo_index_stats(repos, pages, html_table(spark, folder))


_MARKED = f"""{FILES}, marked AS (
  SELECT f.doc_id, f.repo, f.path, f.text, l.quality IS NULL AS missing,
    CASE WHEN l.quality = 0 THEN 'vector_upsert_failed' END AS error
  FROM files f LEFT JOIN labels l USING (doc_id))"""


def marked_documents(spark, folder):
    """Documents with vector marks: unlabelled ones have no vectors, poor ones failed."""
    labels = tables.table(spark, folder, "labels").select("doc_id", "quality")
    return (
        tables.files(spark, folder)
        .join(labels, "doc_id", "left")
        .withColumns(
            {
                "vector_indexed_at": F.when(F.col("quality").isNotNull(), F.lit("2024-01-01")),
                "vector_index_error": F.when(F.col("quality") == 0, F.lit("vector_upsert_failed")),
            }
        )
    )


@query(
    "repo_stats_rollup",
    f"""WITH {_MARKED}, s AS ({_HTML}), n AS (SELECT page_id AS doc_id, count(*) AS c FROM s GROUP BY 1),
rows_all AS (
  SELECT repo, 1 AS documents, coalesce(c, 0) AS symbols, 0 AS vectors, 1 AS files,
    CAST(missing OR error IS NOT NULL AS INTEGER) AS vectors_stale FROM marked LEFT JOIN n USING (doc_id)
  UNION ALL SELECT concat('src', CAST(vec_id % 20 AS STRING)), 0, 0, 1, 0, 0 FROM embeddings)
SELECT repo, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(symbols) AS BIGINT) AS symbols,
  CAST(sum(vectors) AS BIGINT) AS vectors, CAST(sum(files) AS BIGINT) AS files,
  CAST(sum(vectors_stale) AS BIGINT) AS vectors_stale
FROM rows_all GROUP BY ROLLUP (repo)""",
)
def repo_stats_rollup(spark, folder):
    return reports.repo_stats(
        marked_documents(spark, folder),
        html_table(spark, folder),
        tables.chunk_vectors(spark, folder),
        tables.files(spark, folder),
    )


@query(
    "top_dirs",
    f"""WITH {FILES} SELECT string_split(path, '/')[1] AS top_dir, count(*) AS files FROM files
GROUP BY 1 ORDER BY files DESC, top_dir LIMIT 10""",
)
def top_dirs(spark, folder):
    return reports.top_dirs(tables.files(spark, folder))


@query(
    "stale_report",
    f"""WITH {_MARKED}, v AS (SELECT concat('src', CAST(vec_id % 20 AS STRING)) AS repo, count(*) AS n FROM embeddings GROUP BY 1)
SELECT m.repo, count(*) FILTER (missing OR error IS NOT NULL) AS vectors_stale, coalesce(any_value(v.n), 0) AS vectors_in_repo,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes
FROM marked m LEFT JOIN v ON m.repo = v.repo GROUP BY m.repo""",
)
def stale_report(spark, folder):
    sizes = tables.files(spark, folder).withColumn("size", F.octet_length("text").cast("long"))
    return reports.stale_report(
        marked_documents(spark, folder), tables.chunk_vectors(spark, folder), reports.footprint(sizes)
    )


@query(
    "stale_documents",
    f"WITH {_MARKED} SELECT repo, path, error FROM marked WHERE missing OR error IS NOT NULL",
)
def stale_documents(spark, folder):
    return reports.stale_documents(marked_documents(spark, folder))


@query(
    "stale_page",
    f"""WITH {_MARKED} SELECT repo, path, error FROM marked WHERE missing OR error IS NOT NULL
ORDER BY repo, path LIMIT 20 OFFSET 20""",
)
def stale_page(spark, folder):
    return reports.stale_page(marked_documents(spark, folder), 2)


@query(
    "stale_page_deep",
    f"""WITH {_MARKED}, stale AS (SELECT repo, path, error, row_number() OVER (ORDER BY repo, path) AS place,
    count(*) OVER () AS n FROM marked WHERE missing OR error IS NOT NULL)
SELECT repo, path, error FROM stale WHERE (place - 1) // 20 = (n // 20) * 9 // 10""",
)
def stale_page_deep(spark, folder):
    """A page nine tenths into the stale documents, read from the range that holds it."""
    stale = reports.stale_documents(marked_documents(spark, folder))
    index = pages.build_pages(stale, ["repo", "path"], run_folder(spark, "pages"), range_rows=1000)
    return index.page(index.total() // 20 * 9 // 10 + 1)


@query(
    "storage_footprint",
    f"""WITH {FILES} SELECT repo, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM files GROUP BY repo""",
)
def storage_footprint(spark, folder):
    docs = ops.documents_of(tables.files(spark, folder))
    return reports.footprint(docs)


# --- access log ------------------------------------------------------------------------------------------------


@query(
    "redact_query",
    """SELECT page_id, CASE WHEN contains(url, '?') THEN concat(string_split(url, '?')[1], '?<redacted>') ELSE url END AS url
FROM pages""",
)
def redact_query(spark, folder):
    return tables.table(spark, folder, "pages").select("page_id", redact.redact_query("url").alias("url"))


@query(
    "access_log",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'peer' ELSE concat('10.0.0.', CAST(user_id AS STRING)) END AS client_ip,
  '<redacted>' AS x_key, props AS accept,
  CASE WHEN length(repeat(props, 50)) > 500 THEN concat(left(repeat(props, 50), 500), '... [truncated]') ELSE repeat(props, 50) END AS preview
FROM events""",
)
def access_log(spark, folder):
    """events read as requests: user as forwarded address, properties as headers and body."""
    forwarded = F.when(F.col("event_type") == "view", "").otherwise(
        F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 10.1.1.1"))
    )
    log = tables.table(spark, folder, "events").select(
        "event_id",
        F.create_map(
            F.lit("x-forwarded-for"), forwarded, F.lit("X-Api-Key"), "props", F.lit("accept"), "props"
        ).alias("headers"),
        F.repeat("props", 50).alias("body"),
    )
    safe = redact.redact_headers("headers")
    return log.select(
        "event_id",
        redact.client_ip("headers", F.lit("peer")).alias("client_ip"),
        safe["X-Api-Key"].alias("x_key"),
        safe["accept"].alias("accept"),
        redact.body_preview("body").alias("preview"),
    )


@query(
    "log_tail",
    """SELECT event_id, concat(event_type, ' ', props) AS text FROM events ORDER BY event_id DESC LIMIT 200""",
)
def log_tail(spark, folder):
    log = tables.table(spark, folder, "events").select(
        "event_id", F.concat_ws(" ", "event_type", "props").alias("text")
    )
    return tree.log_tail(log, order="event_id")


@query(
    "log_tail_files",
    """SELECT user_id % 16 AS log, concat(CAST(event_id AS STRING), ' ', event_type, ' ', props) AS text, CAST(n AS INTEGER) AS back
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50""",
)
def log_tail_files(spark, folder):
    """The last 50 lines of each of 16 logs, written from the events and read from their ends."""
    base = run_folder(spark, "logs")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props")
    events = tables.table(spark, folder, "events").select((F.col("user_id") % 16).alias("log"), "event_id", line.alias("value"))
    # A log has most of its lines in one file, as logs do: sixteen tasks write a file each.
    ordered = events.repartition(16, "log").sortWithinPartitions("log", "event_id")
    ordered.select("log", "value").write.partitionBy("log").text(base)
    tails = tail.tail_files(spark, base, 50)
    return tails.select(F.regexp_extract("file", "/log=(-?[0-9]+)/", 1).cast("long").alias("log"), "text", "back")


@query(
    "content_hash",
    "SELECT page_id, sha256(html) AS sha FROM pages",
)
def hashes(spark, folder):
    return tables.table(spark, folder, "pages").select("page_id", content_hash("html").alias("sha"))
