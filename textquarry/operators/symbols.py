"""Symbols: definitions found by line rules per language, with scopes from indentation."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.basics import let
from ..functions.text import lines
from .sizing import broadcast_if_small


class Rule(NamedTuple):
    """One line rule: group 1 of the regex is the name, group 2 (if any) the signature."""

    kind: str
    regex: str
    opens_scope: bool = False


_SIG = r"\s*(\([^)]*\))?"
_MODS = r"(?:(?:public|protected|private|internal|static|final|abstract|synchronized|sealed|override|virtual|async|default|native|strictfp)\s+)*"
_C_WORD = r"(?!(?:return|else|if|while|for|switch|do|typedef|case|goto|new|delete|throw)\b)"

_JS = (
    Rule("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", True),
    Rule("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)" + _SIG),
    Rule("interface", r"^\s*(?:export\s+)?interface\s+([\w$]+)", True),
    Rule("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)", True),
    Rule("alias", r"^\s*(?:export\s+)?type\s+([\w$]+)\s*(?:<[^>]*>)?\s*="),
    Rule("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(\([^)]*\))\s*(?::[^=]+)?=>"),
    Rule("constant", r"^(?:export\s+)?const\s+([\w$]+)\s*(?::[^=]+)?=(?!.*=>)"),
    Rule("variable", r"^(?:export\s+)?(?:let|var)\s+([\w$]+)"),
    Rule("method", r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)([\w$]+)\s*(\([^)]*\))\s*(?::[^{]+)?\{"),
)
_C = (
    Rule("macro", r"^\s*#\s*define\s+(\w+)(\([^)]*\))?"),
    Rule("namespace", r"^\s*namespace\s+(\w+)", True),
    Rule("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)\b[^;]*$", True),
    Rule("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*(?:\{|:|$)", True),
    Rule("union", r"^\s*(?:typedef\s+)?union\s+(\w+)\s*(?:\{|$)", True),
    Rule("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)\s*(?:\{|:|$)", True),
    Rule("typedef", r"^\s*typedef\s+[^({]*?\b(\w+)\s*;"),
    Rule("function", r"^\s*" + _C_WORD + r"[A-Za-z_][\w\s\*&:<>,~]*?[\s\*&]([A-Za-z_~]\w*(?:::~?\w+)*)\s*(\([^;{}]*\))\s*(?:const\s*)?(?:noexcept\s*)?\{?\s*$"),
)

# Rules are tried in order and the first that matches a line gives its symbol.
RULES: dict[str, tuple[Rule, ...]] = {
    "python": (
        Rule("class", r"^\s*class\s+(\w+)\s*(?:\(|:)", True),
        Rule("function", r"^\s*(?:async\s+)?def\s+(\w+)" + _SIG, True),
        Rule("variable", r"^([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)"),
    ),
    "javascript": _JS,
    "typescript": _JS,
    "go": (
        Rule("package", r"^package\s+(\w+)"),
        Rule("func", r"^func\s+(?:\([^)]*\)\s*)?(\w+)" + _SIG),
        Rule("struct", r"^type\s+(\w+)\s+struct\b", True),
        Rule("interface", r"^type\s+(\w+)\s+interface\b", True),
        Rule("type", r"^type\s+(\w+)\b"),
        Rule("const", r"^const\s+(\w+)\b"),
        Rule("var", r"^var\s+(\w+)\b"),
    ),
    "rust": (
        Rule("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", True),
        Rule("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", True),
        Rule("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", True),
        Rule("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", True),
        Rule("implementation", r"^\s*impl\b(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?(\w+)", True),
        Rule("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)(?:<[^>]*>)?" + _SIG),
        Rule("macro", r"^\s*macro_rules!\s+(\w+)"),
        Rule("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)\s*:"),
        Rule("variable", r"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(\w+)\s*:"),
        Rule("typedef", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"),
    ),
    "java": (
        Rule("package", r"^\s*package\s+([\w.]+)\s*;"),
        Rule("class", r"^\s*" + _MODS + r"(?:class|record)\s+(\w+)", True),
        Rule("interface", r"^\s*" + _MODS + r"interface\s+(\w+)", True),
        Rule("enum", r"^\s*" + _MODS + r"enum\s+(\w+)", True),
        Rule("method", r"^\s+" + _MODS + r"(?!(?:return|new|else|throw)\b)(?:<[^>]*>\s*)?[\w.<>\[\], ?]+\s+(\w+)\s*(\([^)]*\))\s*(?:throws\s+[\w., ]+)?\s*[{;]"),
        Rule("method", r"^\s+(?:public|protected|private)\s+(\w+)\s*(\([^)]*\))\s*(?:throws\s+[\w., ]+)?\s*\{"),
    ),
    "c": _C,
    "cpp": _C,
    "shell": (
        Rule("function", r"^\s*function\s+([\w:-]+)\s*(?:\(\s*\))?\s*\{?"),
        Rule("function", r"^\s*([\w:-]+)\s*\(\s*\)\s*\{?"),
        Rule("alias", r"^\s*alias\s+([\w:-]+)="),
    ),
    "ruby": (
        Rule("module", r"^\s*module\s+([\w:]+)", True),
        Rule("class", r"^\s*class\s+([\w:]+)", True),
        Rule("singletonMethod", r"^\s*def\s+self\.(\w+[?!=]?)" + _SIG),
        Rule("method", r"^\s*def\s+(\w+[?!=]?)" + _SIG),
    ),
    "markdown": (
        Rule("chapter", r"^#\s+(.+?)\s*#*\s*$", True),
        Rule("section", r"^##\s+(.+?)\s*#*\s*$", True),
        Rule("subsection", r"^###\s+(.+?)\s*#*\s*$", True),
        Rule("subsubsection", r"^####\s+(.+?)\s*#*\s*$", True),
        Rule("l4subsection", r"^#####\s+(.+?)\s*#*\s*$", True),
        Rule("l5subsection", r"^######\s+(.+?)\s*#*\s*$", True),
    ),
}

# HTML may hold many symbols on one line, so it is scanned as a whole text.
HTML_RULES = (
    ("anchor", r"(?is)<a\b[^>]*?\s(?:name|id)\s*=\s*[\"']?([^\"'\s>]+)"),
    ("id", r"(?is)<(?:[b-z][a-z0-9]*|a[a-z0-9]+)\b[^>]*?\sid\s*=\s*[\"']?([^\"'\s>]+)"),
    ("title", r"(?is)<title\b[^>]*>(.*?)</title\s*>"),
    ("heading1", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"),
    ("heading2", r"(?is)<h2\b[^>]*>(.*?)</h2\s*>"),
    ("heading3", r"(?is)<h3\b[^>]*>(.*?)</h3\s*>"),
    ("variable", r"(?is)[\s;>{(](?:var|let|const)\s+([a-z_$][\w$]*)\s*="),
)

_SYMBOL_BLOCK = 256
_FOUND = "array<struct<line:int,name:string,kind:string,signature:string,indent:int,opens:boolean>>"


def _found_sql(language: str, lines_column: str) -> str:
    """SQL for the symbols that the lines of one file define, in line order.

    The many rules are put together as one SQL text, which is far quicker to hand over to
    the JVM than a Column object per step.
    """
    indent = (
        r"length(regexp_extract(x, r'^(#{1,6})\s', 1))"
        if language == "markdown"
        else r"length(regexp_extract(x, r'^([ \t]*)', 1))"
    )
    cases = []
    for rule in RULES[language]:
        regex = "r'" + rule.regex.replace("'", r"\x27") + "'"
        has_signature = re.compile(rule.regex).groups > 1
        signature = f"nullif(regexp_extract(x, {regex}, 2), '')" if has_signature else "NULL"
        cases.append(
            f"WHEN x RLIKE {regex} THEN named_struct('line', i + 1, 'name', "
            f"regexp_extract(x, {regex}, 1), 'kind', '{rule.kind}', 'signature', {signature}, "
            f"'indent', {indent}, 'opens', {str(rule.opens_scope).lower()})"
        )
    marked = f"transform({lines_column}, (x, i) -> CASE {' '.join(cases)} END)"
    return f"CAST(filter({marked}, s -> s IS NOT NULL) AS {_FOUND})"


def _scoped(found: Column, language: Column) -> Column:
    """Add scopes: the nearest earlier scope-opening symbol with a smaller indent.

    Runs over the symbols of one file in line order with a stack of open scopes. Every step
    copies the array it appends to, so results are gathered in blocks.
    """
    out_type = "array<struct<line:int,name:string,kind:string,signature:string,scope:string>>"
    stack_type = "array<struct<indent:int,name:string,kind:string>>"

    def placed(stack: Column, s: Column) -> Column:
        parent = F.try_element_at(stack, F.lit(-1))["kind"]
        kind = (
            F.when(s["kind"] != "function", s["kind"])
            .when((language == "python") & (parent == "class"), "member")
            .when((language == "rust") & parent.isin("implementation", "interface"), "method")
            .otherwise(s["kind"])
        )
        names = F.array_join(F.transform(stack, lambda x: x["name"]), ".")
        return F.struct(
            s["line"].alias("line"),
            s["name"].alias("name"),
            kind.alias("kind"),
            s["signature"].alias("signature"),
            F.when(F.size(stack) > 0, names).alias("scope"),
        )

    def step(acc: Column, s: Column) -> Column:
        here = F.struct(*[s[c].alias(c) for c in ("indent", "name", "kind")])
        return let(
            F.filter(acc["stack"], lambda x: x["indent"] < s["indent"]),
            lambda stack: F.struct(
                F.when(s["opens"], F.array_append(stack, here)).otherwise(stack).alias("stack"),
                F.array_append(acc["out"], placed(stack, s)).alias("out"),
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _SYMBOL_BLOCK).cast("int")),
        lambda b: F.slice(found, b * _SYMBOL_BLOCK + 1, _SYMBOL_BLOCK),
    )

    def block_step(acc: Column, block: Column) -> Column:
        start = F.struct(acc["stack"].alias("stack"), F.array().cast(out_type).alias("out"))
        return let(
            F.aggregate(block, start, step),
            lambda r: F.struct(
                r["stack"].alias("stack"), F.array_append(acc["outs"], r["out"]).alias("outs")
            ),
        )

    first = F.struct(
        F.array().cast(stack_type).alias("stack"), F.array().cast(f"array<{out_type}>").alias("outs")
    )
    return F.aggregate(blocks, first, block_step, lambda acc: F.flatten(acc["outs"]))


def extract_symbols(
    files: DataFrame, keys: tuple[str, ...] = ("doc_id",), language: Column | None = None
) -> DataFrame:
    """(keys..., name, kind, line, signature, scope) of files with ``path`` and ``text``.

    All rules run inside the file's row, so only symbols, never lines, leave it.
    """
    lang = paths.language_of("path") if language is None else language
    by_language = " ".join(f"WHEN '{n}' THEN {_found_sql(n, '__lines')}" for n in RULES)
    return (
        files.select(*keys, lang.alias("__lang"), "text")
        .where(F.col("__lang").isin(*RULES))
        .select(*keys, "__lang", lines("text").alias("__lines"))
        .select(*keys, "__lang", F.expr(f"CASE __lang {by_language} END").alias("__found"))
        .where(F.size("__found") > 0)
        .select(*keys, F.explode(_scoped(F.col("__found"), F.col("__lang"))).alias("s"))
        .select(*keys, "s.name", "s.kind", "s.line", "s.signature", "s.scope")
    )


def html_symbols(
    pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html"
) -> DataFrame:
    """(keys..., kind, ordinal, name): titles, headings, anchors, ids and script variables."""
    def matches(kind: str, regex: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col(html), F.lit(regex), F.lit(1)),
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                (i + 1).alias("ordinal"),
                F.trim(F.regexp_replace(x, r"<[^>]*>", "")).alias("name"),
            ),
        )

    found = F.concat(*[matches(kind, regex) for kind, regex in HTML_RULES])
    return (
        pages.select(*keys, F.explode(found).alias("s"))
        .select(*keys, "s.kind", "s.ordinal", "s.name")
        .where(F.length("name") > 0)
    )


# --- lookups -------------------------------------------------------------------------------------


def _filtered(symbols: DataFrame, name, kind) -> DataFrame:
    if name is not None:
        symbols = symbols.where(F.col("name") == name)
    return symbols if kind is None else symbols.where(F.col("kind") == kind)


def _with_documents(symbols: DataFrame, documents: DataFrame, repo, path) -> DataFrame:
    docs = documents.select("doc_id", "repo", "path")
    docs = docs if repo is None else docs.where(F.col("repo") == repo)
    docs = docs if path is None else docs.where(F.col("path") == path)
    return symbols.join(docs, "doc_id")


def find_symbol(
    symbols: DataFrame,
    documents: DataFrame,
    name: str,
    repo: str | None = None,
    kind: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Definitions of a name, with ``file_path`` = ``repo::path``."""
    hits = _with_documents(_filtered(symbols, name, kind), documents, repo, path)
    return hits.select(
        "name", "kind", paths.hit_id("repo", "path").alias("file_path"), "line", "signature", "scope"
    )


def list_symbols(
    symbols: DataFrame,
    documents: DataFrame,
    repo: str | None = None,
    kind: str | None = None,
    path: str | None = None,
    *,
    ordered: bool = True,
) -> DataFrame:
    """Outline: every symbol with its file, by path and line."""
    hits = _with_documents(_filtered(symbols, None, kind), documents, repo, path).select(
        "name", "kind", paths.hit_id("repo", "path").alias("file_path"), "line", "signature", "scope"
    )
    return hits.orderBy("file_path", "line", "name") if ordered else hits


def symbols_of_docs(symbols: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return symbols.join(broadcast_if_small(doc_ids.select("doc_id").distinct()), "doc_id", "left_semi")
