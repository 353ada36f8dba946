"""Ignore patterns from large tables, matched by equality on keys of paths.

Nearly all patterns of ignore files name a path, a file name, a directory or an extension.
Each becomes one or two keys that a path has exactly if the pattern matches it, so that files
and rules meet in an equi-join, however many rules a repo has. What is left, true globs, runs
as regular expressions on the paths of repos that have such patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from .ignore import ignore_decision
from .sizing import broadcast_if_small, staged

# The first letter of a key says what of a path has to be equal to the rest:
WHOLE = "w"  # the path
NAME = "n"  # its last part
ABOVE = "p"  # a directory it lies in, from the root
TAIL = "s"  # its last parts, or all
BELOW = "b"  # its last parts, but not all
INSIDE = "i"  # neighbouring directories it lies in
ENDING = "e"  # the end of its last part, from a dot on
ENDING_BELOW = "f"  # the same, of a path with a directory
DIR_ENDING = "d"  # the end of a directory's name, from a dot on
_ENDINGS = (ENDING, ENDING_BELOW, DIR_ENDING)
_GLOB = re.compile(r"[*?\[]")
_BETWEEN = re.compile(r"[*?/\\]")
_ROWS = 1 << 16  # literals of an output batch, beside those of a last path
_LISTS = 1024  # lists of globs that a task keeps compiled


def keys_of(pattern: str, *, strict: bool = False) -> list[str] | None:
    """The keys of which a path must have one to match the pattern (without its ``!``), or
    None for a true glob. The meaning is that of :func:`paths.pattern_regex`."""
    return _strict_keys(pattern) if strict else _keys(pattern)


def _ending(core: str) -> str | None:
    """The end from a dot on of a core like ``*.log``, without further parts or signs."""
    tail = core[1:]
    return tail if core[:1] == "*" and tail[:1] == "." and "/" not in tail and not _GLOB.search(tail) else None


def _keys(pattern: str) -> list[str] | None:
    if pattern.endswith("/"):
        core = pattern.rstrip("/")
        if not _GLOB.search(core):
            return [ABOVE + core, TAIL + core]
        end = _ending(core)  # the core is also read as it stands, signs included
        return [WHOLE + core, ABOVE + core, ENDING + end] if end else None
    anchored, core = pattern.startswith("/"), pattern.lstrip("/")
    if not _GLOB.search(core):
        return [WHOLE + core, NAME + core] if anchored else [TAIL + core]
    if end := _ending(core):
        return [ENDING + end]
    if core.startswith("**/") and not anchored:
        rest = core[3:]
        if not _GLOB.search(rest):
            return [BELOW + rest]
        if end := _ending(rest):
            return [ENDING_BELOW + end]
    inner = core[:-2] if core.endswith("/*") else core[:-3] if core.endswith("/**") else ""
    if inner and not _GLOB.search(inner):
        return [ABOVE + inner] if anchored else [INSIDE + inner]
    return None


def _strict_keys(pattern: str) -> list[str] | None:
    core, directory = pattern.strip("/"), pattern.endswith("/")
    anchored = pattern.startswith("/") or "/" in core
    if not _GLOB.search(core):
        if anchored:
            return [ABOVE + core] if directory else [WHOLE + core, ABOVE + core]
        return [INSIDE + core] if directory else [INSIDE + core, NAME + core]
    if not anchored and (end := _ending(core)):
        return [DIR_ENDING + end] if directory else [DIR_ENDING + end, ENDING + end]
    if core.startswith("**/") and not pattern.startswith("/") and not _GLOB.search(core[3:]):
        return [INSIDE + core[3:]] if directory else [INSIDE + core[3:], TAIL + core[3:]]
    if core.endswith("/**") and not directory and not _GLOB.search(core[:-3]):
        return [ABOVE + core[:-3]]
    return None


def literal_of(pattern: str) -> str:
    """The longest run of plain characters that a path must have in one of its parts to match a
    true glob; empty if there is none. What lies between brackets is not looked at."""
    head, *rest = pattern.split("[", 1)
    runs = _BETWEEN.split(head) + (_BETWEEN.split(rest[0].rsplit("]", 1)[1]) if rest and "]" in rest[0] else [])
    return max(runs, key=len)


def compiled_rules(patterns: DataFrame, *, strict: bool = False) -> DataFrame:
    """(repo, ord, negated, keys, regex, literal) of (repo, ord, pattern): keys where equality
    decides, else a regular expression and its literal. Empty patterns are left out."""

    @F.pandas_udf("keys array<string>, regex string, literal string")
    def compiled(pattern):
        import pandas as pd

        keys = [keys_of(p, strict=strict) for p in pattern]
        glob = [None if k else paths.pattern_regex(p, strict=strict).replace(r"\z", r"\Z") for k, p in zip(keys, pattern)]
        literal = [None if k else literal_of(p) for k, p in zip(keys, pattern)]
        return pd.DataFrame({"keys": keys, "regex": glob, "literal": literal})

    negated = F.startswith(F.col("pattern"), F.lit("!"))
    body = F.when(negated, F.substring("pattern", 2, 2**31 - 1)).otherwise(F.col("pattern"))
    rules = patterns.where(F.length("pattern") > 0).select("repo", "ord", negated.alias("negated"), compiled(body).alias("c"))
    return rules.select("repo", "ord", "negated", "c.keys", "c.regex", "c.literal")


def path_keys(path: Column, depths: dict[str, int]) -> Column:
    """Array of the keys of a path. ``depths`` has the kinds that rules use, with the largest
    number of parts (or dots of an ending) of such a rule: longer runs can match nothing, so
    the keys of a path with very many parts stay few."""
    parts = F.split(path, "/")
    n = F.size(parts)
    name = F.element_at(parts, -1)
    joined = lambda start, count: F.array_join(F.slice(parts, start, count), "/")
    up_to = lambda most: F.sequence(F.lit(1), F.greatest(most, F.lit(1)))

    def runs(kind: str, most: Column, key) -> Column:
        marked = F.transform(up_to(F.least(most, F.lit(depths[kind]))), lambda i: F.concat(F.lit(kind), key(i)))
        return F.when(most >= 1, marked).otherwise(F.array())

    def endings(kind: str, part: Column) -> Column:
        dots = F.split(part, r"(?=\.)", -1)
        most = F.least(F.size(dots), F.lit(depths[kind]))
        all_of = F.transform(up_to(most), lambda i: F.array_join(F.slice(dots, -i, i), ""))
        return F.transform(F.filter(all_of, lambda x: F.startswith(x, F.lit("."))), lambda x: F.concat(F.lit(kind), x))

    dirs = F.slice(parts, 1, n - 1)
    made = {
        WHOLE: lambda: F.array(F.concat(F.lit(WHOLE), path)),
        NAME: lambda: F.array(F.concat(F.lit(NAME), name)),
        ABOVE: lambda: runs(ABOVE, n - 1, lambda i: joined(1, i)),
        TAIL: lambda: runs(TAIL, n, lambda i: joined(-i, i)),
        BELOW: lambda: runs(BELOW, n - 1, lambda i: joined(-i, i)),
        INSIDE: lambda: F.flatten(
            F.transform(
                F.when(n > 1, up_to(n - 1)).otherwise(F.array().cast("array<int>")),
                lambda start: runs(INSIDE, n - start, lambda i: joined(start, i)),
            )
        ),
        ENDING: lambda: endings(ENDING, name),
        ENDING_BELOW: lambda: F.when(n > 1, endings(ENDING_BELOW, name)).otherwise(F.array()),
        DIR_ENDING: lambda: F.flatten(F.transform(dirs, lambda d: endings(DIR_ENDING, d))),
    }
    return F.array_distinct(F.concat(*(made[kind]() for kind in made if kind in depths)))


@lru_cache(maxsize=4096)
def _pattern(regex: str) -> re.Pattern:
    return re.compile(regex)


def _literal_parts(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, literal): of each file the literals, of a length that its repo's globs have,
    that its path holds. The empty one is in every path."""
    sizes = rules.groupBy("repo").agg(F.sort_array(F.collect_set(F.length("literal"))).alias("sizes"))
    schema = T.StructType([*files.select("repo", "path").schema.fields, rules.schema["literal"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("sizes").to_pylist()
            rows, found = [], []
            for i, path in enumerate(batch.column("path")):
                parts = path.as_py().split("/")
                held = {p[a : a + n] for n in sizes[i] for p in parts for a in range(len(p) - n + 1)}
                rows += [i] * len(held)
                found += held
                if len(rows) >= _ROWS:
                    yield pieces(batch, rows, found)
                    rows, found = [], []
            yield pieces(batch, rows, found)

    def pieces(batch: pa.RecordBatch, rows: list[int], found: list[str]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        columns = [batch.column("repo").take(at), batch.column("path").take(at), pa.array(found, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return files.join(broadcast_if_small(sizes), "repo").select("repo", "path", "sizes").mapInArrow(cut, schema)


def _glob_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, ord, negated): of each file the true globs of its repo that match, the last
    one at least. A glob meets only paths that hold its literal, by an equi-join. Globs of one
    literal, or without any, are tried from the last to the first match."""
    listed = rules.groupBy("repo", "literal").agg(F.sort_array(F.collect_list(F.struct("ord", "negated", "regex")), asc=False).alias("globs"))
    schema = T.StructType([*files.select("repo", "path").schema.fields, rules.schema["ord"], rules.schema["negated"]])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[tuple[str, str], list] = {}
        for batch in batches:
            globs = batch.column("globs")
            rows, ords, negated = [], [], []
            of = zip(batch.column("repo").to_pylist(), batch.column("literal").to_pylist())
            for i, (key, path) in enumerate(zip(of, batch.column("path").to_pylist())):
                tried = compiled.get(key)
                if tried is None:
                    if len(compiled) >= _LISTS:
                        compiled.clear()
                    tried = compiled[key] = [(g["ord"], g["negated"], _pattern(g["regex"])) for g in globs[i].as_py()]
                hit = next(((o, neg) for o, neg, regex in tried if regex.match(path)), None)
                if hit:
                    rows.append(i)
                    ords.append(hit[0])
                    negated.append(hit[1])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("repo").take(at), batch.column("path").take(at), pa.array(ords, out[2]), pa.array(negated, out[3])], schema.names
            )

    from pyspark.sql.pandas.types import to_arrow_type

    out = [to_arrow_type(f.dataType) for f in schema.fields]
    met = _literal_parts(files, rules).join(broadcast_if_small(listed), ["repo", "literal"])
    return met.select("repo", "path", "literal", "globs").mapInArrow(last, schema)


def last_rule(files: DataFrame, patterns: DataFrame, *, strict: bool = False) -> DataFrame:
    """(repo, path, ord, negated): of each (repo, path) of ``files`` the last rule in ``patterns``
    (repo, ord, pattern) that matches; paths that no rule matches have no row.

    Rows that are null in repo or path match nothing, repeated paths have one row. Only
    matches are shuffled, folded on the map side to one for each path of a task.
    """
    rules = staged(compiled_rules(patterns, strict=strict), "rules")
    places = rules.select("repo", "ord", "negated", F.explode("keys").alias("key"))
    kind = F.substring("key", 1, 1)
    n_parts = F.when(kind.isin(*_ENDINGS), F.size(F.split("key", r"\.")) - 1).otherwise(F.size(F.split("key", "/")))
    # A row for each of nine kinds.
    depths = {r["kind"]: r["depth"] for r in places.groupBy(kind.alias("kind")).agg(F.max(n_parts).alias("depth")).collect()}
    known = files.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select("repo", "path")
    found = []
    if depths:
        # Of rules with one key the last decides.
        rule = places.groupBy("repo", "key").agg(F.max(F.struct("ord", "negated")).alias("rule"))
        keyed = known.select("repo", "path", F.explode(path_keys(F.col("path"), depths)).alias("key"))
        met = keyed.join(broadcast_if_small(staged(rule, "rule-keys")), ["repo", "key"])
        found.append(met.select("repo", "path", "rule.ord", "rule.negated"))
    globs = rules.where("regex IS NOT NULL").select("repo", "ord", "negated", "regex", "literal")
    if globs.head(1):
        found.append(_glob_matches(known, globs))
    if not found:
        return files.sparkSession.createDataFrame([], f"repo string, path string, ord {rules.schema['ord'].dataType.simpleString()}, negated boolean")
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    last = every.groupBy("repo", "path").agg(F.max(F.struct("ord", "negated")).alias("rule"))
    return last.select("repo", "path", "rule.ord", "rule.negated")


def with_rule_match(files: DataFrame, patterns: DataFrame, name: str, *, strict: bool = False) -> DataFrame:
    """``files`` with a boolean ``name``: whether the last matching rule of the file's repo
    takes it in. Files with no matching rule are false."""
    decided = staged(last_rule(files, patterns, strict=strict), "last-rules")
    hit = decided.where("NOT negated").select(F.col("repo").alias("__repo"), F.col("path").alias("__path"), F.lit(True).alias(name))
    joined = files.join(broadcast_if_small(hit), (files["repo"] == F.col("__repo")) & (files["path"] == F.col("__path")), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop("__repo", "__path")


def with_rules_decision(
    files: DataFrame, ignore_patterns: DataFrame, include_patterns: DataFrame | None = None, **rules
) -> DataFrame:
    """:func:`ignore.with_decision` where each repo brings its own ignore and include patterns,
    of any number. Same results as :func:`ignore.with_table_decision`, which holds a repo's
    patterns in every row and suits short lists."""
    strict = rules.get("strict_gitignore", False)
    marked = with_rule_match(files, ignore_patterns, "__git", strict=strict)
    extra = {"gitignore_match": F.col("__git")}
    if include_patterns is not None:
        marked = with_rule_match(marked, include_patterns, "__inc")
        extra["include_match"] = F.col("__inc")
    decided = marked.withColumn("__d", ignore_decision(**rules, **extra))
    return decided.select(*files.columns, F.col("__d.ignored").alias("ignored"), F.col("__d.reason").alias("reason"))


def watched_by_rules(events: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """The change events that the patterns of their repos, matched by :func:`last_rule`, and the
    other rules of :func:`ignore.event_dropped` keep. For static tables of events; a stream
    applies it to each micro-batch."""
    from .ignore import event_dropped

    marked = with_rule_match(events, patterns, "__git")
    return marked.where(~event_dropped(gitignore_match=F.col("__git"), **options)).select(*events.columns)
