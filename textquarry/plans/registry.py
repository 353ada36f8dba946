"""Registry of queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what another engine must agree with."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- pieces of checking SQL ------------------------------------------------------------------

_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_SPACES = (
    r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}"
)

FILES = """files AS (
  SELECT doc_id, source AS repo, concat(lang, '/', CASE WHEN doc_id % 11 = 0 THEN 'build/' ELSE '' END,
    'doc_', CAST(doc_id AS STRING), CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md'
      WHEN 2 THEN '.json' WHEN 3 THEN '.ts' WHEN 4 THEN '.csv' WHEN 5 THEN '.log' WHEN 6 THEN '.h'
      ELSE '' END) AS path, text
  FROM documents)"""


def lines_of(source: str, text: str = "text", name: str = "ln") -> str:
    """CTEs adding the array ``l`` of lines to every row of ``source``."""
    return f"""{name}_split AS (
  SELECT *, regexp_split_to_array({text}, '{_BREAKS}') AS s FROM {source}),
{name} AS (
  SELECT * EXCLUDE (s), CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS l FROM {name}_split)"""


def each_line(source: str = "ln", columns: str = "doc_id, repo, path", name: str = "line_rows") -> str:
    """CTE with one row (columns, line, raw) per line."""
    return f"""{name} AS (
  SELECT {columns}, unnest(l) AS raw, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line
  FROM {source})"""


def stripped(value: str) -> str:
    return f"regexp_replace({value}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def words(value: str) -> str:
    return f"greatest(1, len(regexp_extract_all({value}, '[^{_SPACES}]+')))"


def grams_of(source: str, key: str = "doc_id", text: str = "text", name: str = "pairs") -> str:
    """CTE of distinct (key, gram)."""
    return f"""{name}_chars AS (SELECT {key}, string_split(lower({text}), '') AS c FROM {source}),
{name} AS (
  SELECT DISTINCT {key}, c[i] || c[i + 1] || c[i + 2] AS gram
  FROM (SELECT {key}, c, unnest(range(1, len(c) - 1)) AS i FROM {name}_chars))"""


def head_bytes(text: str, n: int) -> str:
    """First ``n`` bytes of a text, a broken last character replaced, with the cut mark."""
    blob = f"encode({text})"
    tries = ", ".join(
        f"try(decode({blob}[1:{n - k}]))" + (" || chr(65533)" if k else "") for k in range(4)
    )
    return (
        f"CASE WHEN octet_length({blob}) > {n} THEN coalesce({tries}) || "
        f"chr(10) || chr(10) || '[... truncated ...]' ELSE {text} END"
    )
