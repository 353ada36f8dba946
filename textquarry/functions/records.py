"""Structured text sources: JSONL records and notebooks turned into plain text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .basics import ColumnOrName, col, let
from .text import lines, strip

_NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:string>>>"


def notebook_text(text: ColumnOrName) -> Column:
    """Sources of the code and markdown cells joined by blank lines; null when there are
    none or the file is not a notebook. A source may be a string or a list of strings."""

    def source(cell: Column) -> Column:
        listed = F.from_json(cell["source"], "array<string>")
        return F.when(
            F.startswith(F.ltrim(cell["source"]), F.lit("[")) & listed.isNotNull(),
            F.array_join(listed, ""),
        ).otherwise(cell["source"])

    cells = F.from_json(col(text), _NOTEBOOK)["cells"]
    kept = F.filter(
        F.transform(
            F.filter(cells, lambda c: c["cell_type"].isin("code", "markdown")), source
        ),
        lambda s: s.isNotNull() & (strip(s) != ""),
    )
    return let(F.array_join(kept, "\n\n"), lambda t: F.when(strip(t) != "", t))


def record_lines(text: ColumnOrName) -> Column:
    """Non-empty stripped lines of a JSONL file."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def canonical_record(line: ColumnOrName, include_solution: Column | bool = True) -> Column:
    """Text of one JSONL record for indexing.

    The first non-empty main field, signature and documentation field are joined by blank
    lines; without any, every long string value is. A solution field may follow. Lines that
    are not JSON objects are taken as they are, and so are objects without any of these.

    Values keep their JSON types: empty are the empty string, list and object, zero, false
    and null, but not a string that reads like one of these, and only strings are free text.
    Lists of the main and solution fields are joined by line breaks. Booleans read True and
    False; lists elsewhere and nested objects keep their JSON spelling, for which
    :func:`canonical_record_exact` gives Python's.
    """
    raw = col(line)
    keep_solution = F.lit(include_solution) if isinstance(include_solution, bool) else include_solution

    def build(m: Column) -> Column:
        def first(keys, listed: bool = False) -> Column:
            named = F.transform(F.split(F.lit(",".join(keys)), ","), lambda k: F.try_element_at(m, k))
            kept = F.filter(named, lambda v: v.isNotNull() & ~_empty(v))
            shown = F.transform(F.slice(kept, 1, 1), lambda v: _joined(v) if listed else _shown(v))
            return F.try_element_at(shown, F.lit(1))

        parts = F.array_compact(
            F.array(
                first(fixed.RECORD_MAIN_FIELDS, True),
                first(fixed.RECORD_SIGNATURE_FIELDS),
                first(fixed.RECORD_DOC_FIELDS),
            )
        )
        strings = F.filter(F.map_values(m), lambda v: _kind(v) == "STRING")
        free_text = F.filter(
            F.transform(strings, lambda v: v.cast("string")),
            lambda v: F.length(v) > fixed.RECORD_MIN_FREE_TEXT,
        )
        chosen = F.when(F.size(parts) > 0, parts).otherwise(free_text)
        solution = first(fixed.RECORD_SOLUTION_FIELDS, True)
        ending = F.when(
            keep_solution & solution.isNotNull(), F.concat(F.lit(fixed.SOLUTION_MARK), solution)
        ).otherwise(F.lit(""))
        return let(
            chosen,
            lambda ps: F.when(
                F.size(ps) > 0, F.concat(F.array_join(ps, "\n\n"), ending)
            ).otherwise(raw),
        )

    return let(
        F.from_json(raw, "map<string,variant>"),
        lambda m: F.when(m.isNull(), raw).otherwise(build(m)),
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _empty(v: Column) -> Column:
    kind = _kind(v)
    return (
        F.when(kind == "STRING", v.cast("string") == "")
        .when(kind == "BOOLEAN", v.cast("string") == "false")
        .when(F.startswith(kind, F.lit("ARRAY")), F.size(F.try_variant_get(v, "$", "array<variant>")) == 0)
        .when(F.startswith(kind, F.lit("OBJECT")), kind == "OBJECT<>")
        .when(kind == "VOID", F.lit(True))
        .otherwise(v.cast("double") == 0)
    )


def _shown(v: Column) -> Column:
    kind = _kind(v)
    return (
        F.when(kind == "BOOLEAN", F.initcap(v.cast("string")))
        .when(kind == "VOID", F.lit("None"))
        .otherwise(v.cast("string"))
    )


def _joined(v: Column) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(items, lambda x: F.coalesce(_shown(x), F.lit("None"))), "\n")
    return F.when(F.startswith(_kind(v), F.lit("ARRAY")), joined).otherwise(_shown(v))


def _python_record(line: str, keep_solution: bool) -> str:
    try:
        obj = json.loads(line)
    except ValueError:
        return line
    if not isinstance(obj, dict):
        return str(obj)

    def pick(keys):
        return next((obj[k] for k in keys if obj.get(k)), None)

    def shown(v):
        return "\n".join(map(str, v)) if isinstance(v, list) else str(v)

    main, sig, doc = map(
        pick, (fixed.RECORD_MAIN_FIELDS, fixed.RECORD_SIGNATURE_FIELDS, fixed.RECORD_DOC_FIELDS)
    )
    found = [shown(main)] if main else []
    found += [str(v) for v in (sig, doc) if v]
    if not found:
        found = [
            v for v in obj.values() if isinstance(v, str) and len(v) > fixed.RECORD_MIN_FREE_TEXT
        ]
    if not found:
        return json.dumps(obj, separators=(",", ":"))
    solution = pick(fixed.RECORD_SOLUTION_FIELDS) if keep_solution else None
    return "\n\n".join(found) + (fixed.SOLUTION_MARK + shown(solution) if solution else "")


@F.pandas_udf(T.StringType())
def canonical_record_exact(line: pd.Series, keep_solution: pd.Series) -> pd.Series:
    """Vectorised form of :func:`canonical_record` with Python's spelling of every value."""
    return pd.Series([_python_record(a, bool(b)) for a, b in zip(line, keep_solution)])
