"""Symbols of languages with braces: scopes from brace depth, definitions over several lines.

The line rules of :mod:`symbols` say what a definition looks like. Here they see code whose
comments and strings are blanked, a line alone or joined with the lines up to the next brace
or semicolon, and a symbol's scope is what encloses it between matching braces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from .symbols import RULES, Rule, extract_symbols

LANGUAGES = ("javascript", "typescript", "go", "rust", "java", "c", "cpp")
JOINED = 40  # lines of one definition's head

_BLOCK, _LINE = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"  # a lone quote, as of a Rust lifetime, is none
_SKIPPED = {
    "javascript": (_BLOCK, _LINE, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`?"),
    "go": (_BLOCK, _LINE, _DOUBLE, _CHAR, r"`[^`]*`?"),
    "rust": (_BLOCK, _LINE, r'\bb?r(#*)".*?(?:"\1|\Z)', _DOUBLE, _CHAR),
    "java": (_BLOCK, _LINE, r'"""(?:\\.|(?!""")[^\\])*(?:"""|\Z)', _DOUBLE, _CHAR),
    "c": (_BLOCK, _LINE, _DOUBLE, _CHAR),
}
_SKIPPED["typescript"], _SKIPPED["cpp"] = _SKIPPED["javascript"], _SKIPPED["c"]
_BLANKS = {k: re.compile("|".join(f"(?:{p})" for p in v), re.DOTALL) for k, v in _SKIPPED.items()}
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\\n|\\)*", re.MULTILINE)
_BREAK = re.compile(r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")  # as lines are cut, but for the line feed
_INSIDE = re.compile(r"[^\n]")
_SIGNS = re.compile(r"[{}();]|\[|\]")

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>")
_GOES_ON = re.compile(r"\s*(?:(?:extends|implements|where|throws|permits|const|noexcept|override|final)\b|[:,>&)]|->|\w+\s*:)")

# Kinds whose braces are scopes; methods stand in types, C functions not in functions.
_SCOPES = frozenset("class struct union interface enum namespace module implementation function func method".split())
_TYPES = frozenset("class interface enum struct implementation".split())


def _compiled(language: str) -> list[tuple[Rule, re.Pattern]]:
    return [(rule, re.compile(rule.regex)) for rule in RULES[language]]


def blanked(text: str, language: str) -> str:
    """Code of the same length in which comments and the insides of strings are spaces."""

    def blank(m: re.Match) -> str:
        raw = m.group()
        if raw[0] == "/":
            return _INSIDE.sub(" ", raw)
        return raw[0] + _INSIDE.sub(" ", raw[1:-1]) + raw[-1] if len(raw) > 1 else raw

    return _BLANKS[language].sub(blank, text)


def _signs(code: str) -> tuple[list[int], list[str], dict[int, int]]:
    """Where a head may end (braces and semicolons outside round and square brackets), which sign
    it is, and the place of the closing brace of each opening one."""
    at, sign, ends, open_braces, depth = [], [], {}, [], []
    for m in _SIGNS.finditer(code):
        c, place = m.group(), m.start()
        if c in "([":
            depth.append(c)
        elif c in ")]":
            if depth and depth[-1] in "([":
                depth.pop()
        elif c == "{":
            if not depth or depth[-1] == "{":
                at.append(place)
                sign.append(c)
            depth.append(c)
            open_braces.append(place)
        elif c == "}":
            while depth and depth.pop() != "{":
                pass  # brackets that a stray sign has left open
            if open_braces:
                ends[open_braces.pop()] = place
            if not depth or depth[-1] == "{":
                at.append(place)
                sign.append(c)
        elif not depth or depth[-1] == "{":
            at.append(place)
            sign.append(c)
    return at, sign, ends


def find_symbols(text: str, language: str, rules: list[tuple[Rule, re.Pattern]] | None = None) -> list[tuple]:
    """(name, kind, line, signature, scope) of a source text, in order of the names' places."""
    rules = rules or _compiled(language)
    text = _BREAK.sub(lambda m: " \n"[-len(m.group()) :], text)
    code, out = blanked(text, language), []
    macros = [x for x in rules if x[0].kind == "macro"] if language in ("c", "cpp") else []
    if macros:  # a directive's braces are no scopes
        heads = [(m.start(), m.group()) for m in _DIRECTIVE.finditer(code)]
        code = _DIRECTIVE.sub(lambda m: _INSIDE.sub(" ", m.group()), code)
    at, sign, ends = _signs(code)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    hits: dict[int, tuple[Rule, re.Match]] = {}
    for i, start in enumerate(starts):
        stop = starts[i + 1] - 1 if i + 1 < len(starts) else len(code)
        if not code[start:stop].strip():
            continue
        found = _first(rules, code[start:stop])
        if found is None or _open_signature(found[1]):
            end = bisect_left(at, start)
            if end < len(at) and stop <= at[end] < (starts[i + JOINED] if i + JOINED < len(starts) else len(code)):
                head = code[start : at[end] + 1].replace("\n", " ")
                found = _first(rules if found is None else [found], head, found) or found
        if found:
            hits.setdefault(start + found[1].start(1), found)
    for start, raw in heads if macros else ():
        found = _first(macros, raw.replace("\n", " "))
        if found:
            hits[start + found[1].start(1)] = found

    open_scopes: list[tuple[int, str, str]] = []  # closing place, name, kind
    for place in sorted(hits):
        rule, m = hits[place]
        while open_scopes and open_scopes[-1][0] <= place:
            open_scopes.pop()
        name, kind = m.group(1), rule.kind
        parent = open_scopes[-1][2] if open_scopes else None
        if kind == "method" and parent not in _TYPES:
            continue
        if kind == "function" and language in ("c", "cpp") and parent == "function":
            continue
        if kind == "function" and language == "rust" and parent in ("implementation", "interface"):
            kind = "method"
        signature = m.group(2) if m.re.groups > 1 else None
        scope = ".".join(x[1] for x in open_scopes) or None
        line = bisect_left(starts, place + 1)
        out.append((name, kind, line, re.sub(r"\s+", " ", signature) if signature else None, scope))
        # The head ends at the first sign behind the name that is not in its brackets.
        end = bisect_left(at, place + len(name))
        if kind in _SCOPES and end < len(at) and sign[end] == "{" and _one_head(code[place + len(name) : at[end]]):
            open_scopes.append((ends.get(at[end], len(code)), name, kind))
    return out


def _first(rules, head: str, known: tuple[Rule, re.Match] | None = None) -> tuple[Rule, re.Match] | None:
    """The first rule that matches a head; with ``known``, its rule at its own name again."""
    if known is not None:
        m = known[1].re.search(head)
        return (known[0], m) if m and m.start(1) == known[1].start(1) else None
    return next(((rule, m) for rule, regex in rules if (m := regex.search(head))), None)


def _open_signature(m: re.Match) -> bool:
    """Whether a matched line ends inside the brackets behind the name."""
    return m.re.groups > 1 and m.group(2) is None and m.string[m.end(1) :].lstrip().startswith("(")


def _one_head(between: str) -> bool:
    """Whether a definition goes on from its name to a brace: on one line, in brackets, or on
    lines that begin as such lines do."""
    for _ in range(8):  # brackets inside brackets
        shorter = _BRACKETS.sub("", between)
        if shorter == between:
            break
        between = shorter
    return all(not line.strip() or _GOES_ON.match(line) for line in between.split("\n")[1:])


def brace_symbols(files: DataFrame, keys: tuple[str, ...] = ("doc_id",), language: Column | None = None) -> DataFrame:
    """(keys..., name, kind, line, signature, scope) of the files (path, text) in LANGUAGES.

    A symbol's line is that of its name. Methods are reported inside types only, C functions
    not inside functions. Braces in comments, strings and preprocessor lines do not count;
    a brace that is never closed reaches to the end, a stray closing one is passed over.
    JavaScript regular expressions are not told from divisions. Other files and null texts
    have no rows.
    """
    lang = paths.language_of("path") if language is None else language
    rows = files.select(*keys, lang.alias("__lang"), "text").where(F.col("__lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    fields = [T.StructField(c, T.StringType()) for c in ("name", "kind")]
    fields += [T.StructField("line", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("signature", "scope"))]
    schema = T.StructType([*files.select(*keys).schema.fields, *fields])
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {name: _compiled(name) for name in LANGUAGES}
        for batch in batches:
            owner, found = [], []
            for i, (name, text) in enumerate(zip(batch.column("__lang").to_pylist(), batch.column("text"))):
                mine = find_symbols(text.as_py(), name, rules[name])
                owner += [i] * len(mine)
                found += mine
            columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds]
            index = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in keys), *columns], schema.names)

    return rows.mapInArrow(find, schema)


def all_symbols(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Symbols of every language: by braces where there are braces, by line rules elsewhere."""
    by_lines = files.where(~paths.language_of("path").isin(*LANGUAGES))
    return extract_symbols(by_lines, keys).unionByName(brace_symbols(files, keys))
