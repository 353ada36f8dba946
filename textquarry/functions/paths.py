"""Path and glob expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .basics import ColumnOrName, col

_JSONL = r"(?is)\A\.*[^.].*?\.jsonl(?:\..*[^.])?\z|\.jsonl\z"


def basename(path: ColumnOrName) -> Column:
    return F.substring_index(col(path), "/", -1)


def parts(path: ColumnOrName) -> Column:
    return F.split(col(path), "/")


def suffix(path: ColumnOrName) -> Column:
    """Lower-cased last extension with its dot, or an empty string.

    A leading dot names a hidden file and a trailing dot ends the name; neither is an
    extension.
    """
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def has_hidden_part(path: ColumnOrName) -> Column:
    return F.rlike(col(path), F.lit(r"(?:\A|/)\."))


def is_jsonl(path: ColumnOrName) -> Column:
    """Any extension of the file name is ``.jsonl``."""
    return F.rlike(basename(path), F.lit(_JSONL))


def language_of(path: ColumnOrName, table=fixed.DOCUMENT_LANGUAGES) -> Column:
    """Language by extension, ``unknown`` when not listed."""
    ext = suffix(path)
    return F.coalesce(_lookup(ext, table), F.lit("unknown"))


def _lookup(ext: Column, table) -> Column:
    entries = [F.lit(x) for lang, exts in table.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*entries), ext)


def allow_patterns(languages: list[str], existing: list[str] = (), table=None) -> list[str]:
    """Patterns that keep the chosen languages, put before the existing ones."""
    table = table or fixed.CHUNK_LANGUAGES
    exts = sorted({e for lang in languages for e in table.get(lang, ())})
    fresh = [f"!**/*{e}" for e in exts]
    kept = [p.strip() for p in existing if p.strip() and p.strip() not in fresh]
    return (fresh + kept) if fresh else kept


# --- globs ------------------------------------------------------------------------------


def glob_regex(pattern: str, *, cross_slash: bool = True) -> str:
    """Body of a Java regex for a shell glob.

    With ``cross_slash`` a star also matches ``/`` (shell fnmatch). Without it, stars stay
    inside one path part and ``**`` stands for any number of parts.
    """
    star, one = (".*", ".") if cross_slash else ("[^/]*", "[^/]")
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            if not cross_slash and run >= 2:
                if pattern[i + run : i + run + 1] == "/":
                    out.append("(?:.*/)?")
                    i += run + 1
                    continue
                out.append(".*")
            else:
                out.append(star)
            i += run
        elif ch == "?":
            out.append(one)
            i += 1
        elif ch == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in ("!",) else i + 3)
            if end < 0:
                out.append(r"\[")
                i += 1
            else:
                body = pattern[i + 1 : end]
                negate = body.startswith("!")
                body = body[1:] if negate else body
                body = re.sub(r"([\\\[\]&^])", r"\\\1", body)
                out.append(f"[{'^' if negate else ''}{body}]")
                i = end + 1
        else:
            out.append(re.escape(ch) if not ch.isalnum() and ch.isascii() and ch != "_" else ch)
            i += 1
    return "".join(out)


def pattern_regex(pattern: str, *, strict: bool = False) -> str:
    """One anchored Java regex deciding an ignore pattern on a repo-relative path.

    A trailing slash asks for a directory, a leading slash anchors, anything else may
    match at every level. ``strict`` follows git: stars stop at slashes and a directory
    pattern without an inner slash matches at any depth.
    """
    if strict:
        core = pattern.strip("/")
        glob = glob_regex(core, cross_slash=False)
        anchored = pattern.startswith("/") or "/" in core
        lead = "" if anchored else "(?:.*/)?"
        tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
        return rf"(?s)\A{lead}{glob}{tail}\z"
    if pattern.endswith("/"):
        core = pattern.rstrip("/")
        literal = glob_regex("".join(f"[{c}]" if c in "*?[" else c for c in core))
        return rf"(?s)\A(?:{literal}(?:/.*)?|(?:.*/)?{glob_regex(core)})\z"
    glob = glob_regex(pattern.lstrip("/"))
    if pattern.startswith("/"):
        return rf"(?s)\A(?:{glob}|(?:.*/)?(?=[^/]*\z){glob})\z"
    return rf"(?s)\A(?:.*/)?{glob}\z"


def glob_match(value: ColumnOrName, pattern: str) -> Column:
    """Whole-value shell glob."""
    return F.rlike(col(value), F.lit(rf"(?s)\A{glob_regex(pattern)}\z"))


def pattern_match(path: ColumnOrName, pattern: str, *, strict: bool = False) -> Column:
    return F.rlike(col(path), F.lit(pattern_regex(pattern, strict=strict)))


def find_match(path: ColumnOrName, file_glob: str) -> Column:
    """Recursive file search: the glob applies to the tail of the path, part by part."""
    core = file_glob.strip("/")
    return F.rlike(col(path), F.lit(rf"(?s)\A(?:.*/)?{glob_regex(core, cross_slash=False)}\z"))


def last_match(path: ColumnOrName, patterns: list[str], *, strict: bool = False) -> Column:
    """Ordered patterns where the last match wins and ``!`` un-ignores; no match is false."""
    chain = None
    for p in reversed([p for p in patterns if p]):
        negated = p.startswith("!")
        hit = pattern_match(path, p[1:] if negated else p, strict=strict)
        value = F.lit(not negated)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def normalize(path: ColumnOrName) -> Column:
    """Resolve ``.`` and ``..``: struct of the clean path and whether it leaves the root."""
    p = col(path)
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        parts(p),
        F.struct(empty.alias("kept"), F.startswith(p, F.lit("/")).alias("escapes")),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(
            x == "..",
            F.struct(
                F.when(
                    F.size(acc["kept"]) > 0, F.slice(acc["kept"], 1, F.size(acc["kept"]) - 1)
                )
                .otherwise(empty)
                .alias("kept"),
                (acc["escapes"] | (F.size(acc["kept"]) == 0)).alias("escapes"),
            ),
        )
        .otherwise(
            F.struct(F.array_append(acc["kept"], x).alias("kept"), acc["escapes"].alias("escapes"))
        ),
        lambda acc: F.struct(
            F.array_join(acc["kept"], "/").alias("path"), acc["escapes"].alias("escapes")
        ),
    )
    return walked


def hit_id(repo: ColumnOrName, path: ColumnOrName) -> Column:
    return F.concat(col(repo), F.lit("::"), col(path))


def hit_title(repo: ColumnOrName, path: ColumnOrName, line: ColumnOrName | None = None) -> Column:
    base = F.concat(col(repo), F.lit(":"), col(path))
    if line is None:
        return base
    return F.concat(base, F.lit(" (line "), col(line).cast("string"), F.lit(")"))


def hit_url(repo: ColumnOrName, path: ColumnOrName, scheme: str = "corpus://repos/") -> Column:
    return F.concat(F.lit(scheme), hit_id(repo, path))
