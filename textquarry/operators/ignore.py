"""Which files to index: ignore rules with reasons, embedding policy, event prefilter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..functions.basics import let
from ..functions.records import notebook_text
from ..functions.text import lines
from .sizing import broadcast_if_small


def _split(patterns: Iterable[str] | None) -> tuple[list[str], list[str]]:
    cleaned = [p.strip() for p in patterns or () if p and p.strip()]
    cleaned = [p for p in cleaned if not p.startswith("#")]
    allow = [p[1:].strip() for p in cleaned if p.startswith("!")]
    return allow, [p for p in cleaned if not p.startswith("!")]


def _any_match(path: Column, patterns: list[str], root: str) -> Column:
    """A pattern hits the relative path by ignore rules, or the full path or the bare name
    by plain glob."""
    full = F.concat(F.lit(root + "/"), path)
    hits = [
        paths.pattern_match(path, p)
        | paths.glob_match(full, p)
        | paths.glob_match(paths.basename(path), p)
        for p in patterns
    ]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def ignore_decision(
    path: str = "path",
    size: str = "size",
    *,
    include: list[str] = (),
    repo_patterns: list[str] = (),
    global_patterns: list[str] = (),
    gitignore: list[str] = (),
    skip_dirs: Iterable[str] = (),
    skip_extensions: Iterable[str] = (),
    max_size: int = fixed.MAX_FILE_BYTES,
    root: str = "",
    strict_gitignore: bool = False,
    include_match: Column | None = None,
    gitignore_match: Column | None = None,
) -> Column:
    """Struct (ignored, reason): the first rule that applies decides.

    Only the path inside the repo counts for directory and hidden tests, so a repo that
    lies below a dot directory is still indexed. ``include_match`` / ``gitignore_match``
    take the place of the literal lists when patterns come from a table.
    """
    p = F.col(path)
    name = paths.basename(p)
    low_name = F.lower(name)
    repo_allow, repo_deny = _split(repo_patterns)
    global_allow, global_deny = _split(global_patterns)
    dirs = sorted(set(skip_dirs) | {d[1:] for d in skip_dirs if d.startswith(".")})
    parents = F.slice(paths.parts(p), 1, F.size(paths.parts(p)) - 1)
    included = paths.last_match(p, list(include)) if include_match is None else include_match
    git = (
        paths.last_match(p, list(gitignore), strict=strict_gitignore)
        if gitignore_match is None
        else gitignore_match
    )

    rules: list[tuple[str, bool, Column]] = [("include", False, F.coalesce(included, F.lit(False)))]
    for reason, ignored, patterns in (
        ("repo_allow", False, repo_allow),
        ("repo_ignore", True, repo_deny),
        ("global_allow", False, global_allow),
        ("global_ignore", True, global_deny),
    ):
        if patterns:
            rules.append((reason, ignored, _any_match(p, patterns, root)))
    if dirs:
        rules.append(("dir", True, F.arrays_overlap(parents, F.array(*map(F.lit, dirs)))))
    rules += [
        ("build_cache", True, F.contains(F.lower(p), F.lit(fixed.BUILD_CACHE_TOKEN))),
        ("backup", True, _is_backup(low_name)),
    ]
    extensions = list(skip_extensions)
    if extensions:
        rules.append(("extension", True, paths.suffix(p).isin(*extensions)))
    rules += [
        ("hidden", True, paths.has_hidden_part(p)),
        ("timestamp", True, F.contains(name, F.lit(".timestamp-"))),
        ("size", True, F.col(size).isNull() | (F.col(size) > max_size)),
        ("gitignore", True, F.coalesce(git, F.lit(False))),
    ]
    chain = None
    for reason, ignored, test in rules:
        value = F.struct(F.lit(ignored).alias("ignored"), F.lit(reason).alias("reason"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(F.struct(F.lit(False).alias("ignored"), F.lit("keep").alias("reason")))


def _is_backup(low_name: Column) -> Column:
    return (
        F.contains(low_name, F.lit(".backup"))
        | F.endswith(low_name, F.lit("~"))
        | F.endswith(low_name, F.lit(".bak"))
    )


def with_decision(files: DataFrame, **rules) -> DataFrame:
    """Files with columns ``ignored`` and ``reason``."""
    return files.withColumn("__d", ignore_decision(**rules)).select(
        *files.columns, F.col("__d.ignored").alias("ignored"), F.col("__d.reason").alias("reason")
    )


# --- patterns from a table ------------------------------------------------------------------


def rule_arrays(patterns: DataFrame, *, strict: bool = False) -> DataFrame:
    """(repo, rules): each repo's patterns in order, compiled to regexes.

    ``patterns`` has (repo, ord, pattern). One repo's list is the content of its ignore
    files, so the array stays small.
    """

    @F.pandas_udf("string")
    def compiled(pattern):
        return pattern.map(lambda p: paths.pattern_regex(p, strict=strict))

    negated = F.startswith(F.col("pattern"), F.lit("!"))
    body = F.when(negated, F.substring("pattern", 2, 2**31 - 1)).otherwise(F.col("pattern"))
    return (
        patterns.where(F.length("pattern") > 0)
        .select("repo", "ord", negated.alias("negated"), compiled(body).alias("regex"))
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "negated", "regex"))).alias("rules"))
    )


def table_match(path: str, rules: Column) -> Column:
    """Last-match-wins over an array of compiled rules (null or empty: no match)."""
    return F.coalesce(
        F.aggregate(
            rules,
            F.lit(False),
            lambda acc, r: F.when(F.rlike(F.col(path), r["regex"]), ~r["negated"]).otherwise(acc),
        ),
        F.lit(False),
    )


def with_table_decision(
    files: DataFrame, ignore_patterns: DataFrame, include_patterns: DataFrame | None = None, **rules
) -> DataFrame:
    """:func:`with_decision` where each repo brings its own ignore and include patterns."""
    columns = files.columns
    strict = rules.get("strict_gitignore", False)
    joined = files.join(
        broadcast_if_small(
            rule_arrays(ignore_patterns, strict=strict).withColumnRenamed("rules", "__git")
        ),
        "repo",
        "left",
    )
    extra = {"gitignore_match": table_match("path", F.col("__git"))}
    if include_patterns is not None:
        joined = joined.join(
            broadcast_if_small(rule_arrays(include_patterns).withColumnRenamed("rules", "__inc")),
            "repo",
            "left",
        )
        extra["include_match"] = table_match("path", F.col("__inc"))
    decided = joined.withColumn("__d", ignore_decision(**rules, **extra))
    return decided.select(
        *columns, F.col("__d.ignored").alias("ignored"), F.col("__d.reason").alias("reason")
    )


# --- other predicates --------------------------------------------------------------------------


def event_dropped(
    path: str = "path",
    *,
    include: list[str] = (),
    gitignore: list[str] = (),
    skip_dirs: Iterable[str] = fixed.WATCH_SKIP_DIRS,
    include_match: Column | None = None,
    gitignore_match: Column | None = None,
) -> Column:
    """Whether a change event is dropped before anything looks at the file."""
    p = F.col(path)
    included = paths.last_match(p, list(include)) if include_match is None else include_match
    git = paths.last_match(p, list(gitignore)) if gitignore_match is None else gitignore_match
    names = set()
    for d in skip_dirs:
        names |= {d, d.lstrip(".")} if d.startswith(".") else {d, f".{d}"}
    names |= {n[1:] for n in names if n.startswith(".")}
    in_dir = (
        F.arrays_overlap(paths.parts(p), F.array(*map(F.lit, sorted(names)))) if names else F.lit(False)
    )
    return (
        F.when(included, False)
        .when(git, True)
        .otherwise(in_dir)
    )


def embed_text(path: str = "path", text: str = "text") -> Column:
    """Text to embed: the cell sources of a notebook, else the text itself."""
    return F.when(
        paths.suffix(path) == ".ipynb", F.coalesce(notebook_text(text), F.col(text))
    ).otherwise(F.col(text))


def embed_allowed(path: str = "path", text: str = "text") -> Column:
    """Embedding policy: no lock files, backups, or JSONL (a notebook with cells is fine)."""
    ext = paths.suffix(path)
    name = paths.basename(path)
    long_line = F.exists(lines(text), lambda x: F.length(x) > fixed.JSONL_MAX_LINE_CHARS)
    denied = (
        ext.isin(*fixed.NO_EMBED_EXTENSIONS)
        | name.isin(*fixed.NO_EMBED_NAMES)
        | _is_backup(F.lower(name))
    )
    return (
        F.when(paths.is_jsonl(path) & long_line, False)
        .when(ext == ".ipynb", notebook_text(text).isNotNull())
        .otherwise(~denied)
    )


def contained(files: DataFrame, path: str = "path", *, on_escape: str = "drop") -> DataFrame:
    """Clean up paths and refuse those that leave the repo (``drop`` or ``error``)."""
    if on_escape == "error":
        clean = let(
            paths.normalize(path),
            lambda n: F.when(
                n["escapes"],
                F.raise_error(F.concat(F.lit("path escapes its root: "), F.col(path))).cast("string"),
            ).otherwise(n["path"]),
        )
        return files.withColumn(path, clean)
    return (
        files.withColumn("__n", paths.normalize(path))
        .where(~F.col("__n.escapes"))
        .withColumn(path, F.col("__n.path"))
        .drop("__n")
    )
