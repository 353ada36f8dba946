"""Globs, ignore rules, classification and paths against small Python restatements."""

import fnmatch
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths
from textquarry.functions.classify import classify
from textquarry.operators import ignore

PATHS = [
    "src/foo/bar.txt", "foo/bar.txt", "bar.txt", "a/foo/b", "foo", "build/x.o", "x/build/y.c", ".env",
    "a/.hidden/b.py", "keep.txt", "docs/[x].md", "docs/x.md", "deep/er/est/file.tar.gz", "UPPER.TXT",
    "node_modules/a.js", "sp ace/a+b.c", "new\nline.txt", "a/b/c/.gitignore",
]
PATTERNS = [
    "*.txt", "src/**", "/src/foo/*", "bar.txt", "baz/", "foo/", "/foo", "foo", "**/b", "?.c", "[a-f]oo",
    "[!a-f]oo", "docs/[[]x].md", "*", "/*", "build/", "/build/", "a/*/b", "*.tar.*", "[x", "sp ace/",
    "a+b.c", "\\*.txt", "*.TXT", "[]x].md", "**/build/**", "est/",
]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, path string")


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def matches(path, pattern):
    glob = fnmatch.fnmatchcase
    if pattern.endswith("/"):
        p = pattern.rstrip("/")
        return path == p or path.startswith(p + "/") or glob(path, p) or glob(path, "**/" + p)
    p = pattern.lstrip("/")
    hit = glob(path, p) or glob(PurePosixPath(path).name, p)
    return hit or (not pattern.startswith("/") and glob(path, "**/" + p))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_pattern(tree, pattern):
    assert values(tree, paths.pattern_match("path", pattern)) == [matches(p, pattern) for p in PATHS]


@pytest.mark.parametrize(
    "pattern,hits",
    [
        ("build/", {"build/x.o", "x/build/y.c"}),
        ("/build/", {"build/x.o"}),
        ("foo/*.txt", {"foo/bar.txt"}),
        ("**/foo/*.txt", {"foo/bar.txt", "src/foo/bar.txt"}),
        ("*.gz", {"deep/er/est/file.tar.gz"}),
    ],
)
def test_strict_pattern(tree, pattern, hits):
    got = values(tree, paths.pattern_match("path", pattern, strict=True))
    assert {p for p, g in zip(PATHS, got) if g} == hits


@pytest.mark.parametrize(
    "patterns",
    [["*.txt", "!keep.txt"], ["!keep.txt", "*.txt"], [], ["*", "!src/", "bar.txt"], ["!a", ""]],
)
def test_last_match_wins(spark, tree, patterns):
    def decide(p):
        out = False
        for q in filter(None, patterns):
            if matches(p, q.removeprefix("!")):
                out = not q.startswith("!")
        return out

    want = [decide(p) for p in PATHS]
    assert values(tree, paths.last_match("path", patterns)) == want
    table = spark.createDataFrame(
        [("r", i, p) for i, p in enumerate(patterns)], "repo string, ord int, pattern string"
    )
    rules = ignore.rule_arrays(table).select("rules")
    if patterns:
        joined = tree.join(F.broadcast(rules.withColumn("k", F.lit(1))), F.lit(1) == F.col("k"))
        assert values(joined, ignore.table_match("path", F.col("rules"))) == want


@pytest.mark.parametrize("glob", ["*.txt", "*", "foo/*", "**/*.md", "b*", "a/**/b.py", "*.tar.gz"])
def test_find(tree, glob, tmp_path):
    for p in PATHS:
        f = tmp_path / p
        if not f.is_dir() and not any(q.is_file() for q in f.parents):
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("x")
    there = {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()}
    want = {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob(glob) if p.is_file()}
    got = {p for p, g in zip(PATHS, values(tree, paths.find_match("path", glob))) if g}
    assert got & there == want


def test_suffix_and_jsonl(spark):
    names = [
        "a.py", "a.PY", ".bashrc", "a.", "a.tar.gz", "d.x/noext", "..foo", "x.jsonl", "x.JSONL.gz", ".jsonl",
        "x.jsonl.", "x.jsonlx", "a.jsonl.b.c", "d.jsonl/x", "jsonl",
    ]
    df = spark.createDataFrame(list(enumerate(names)), "i int, path string")
    assert values(df, paths.suffix("path")) == [PurePosixPath(n).suffix.lower() for n in names]
    want = [
        any(s.lower() == ".jsonl" for s in PurePosixPath(n).suffixes) or n.lower().endswith(".jsonl")
        for n in names
    ]
    assert values(df, paths.is_jsonl("path")) == want


def test_normalize(spark):
    cases = [
        ("a/b", "a/b", False), ("./a//b/.", "a/b", False), ("a/../b", "b", False), ("../a", "a", True),
        ("a/../../b", "b", True), ("/etc/passwd", "etc/passwd", True), ("", "", False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, path string")
    assert [tuple(v) for v in values(df, paths.normalize("path"))] == [c[1:] for c in cases]
    assert ignore.contained(df).count() == 4
    with pytest.raises(Exception, match="escapes"):
        ignore.contained(df, on_escape="error").collect()


def reasons(spark, rows, **rules):
    df = spark.createDataFrame([(p, s) for p, s in rows], "path string, size long")
    return {r.path: (r.ignored, r.reason) for r in ignore.with_decision(df, **rules).collect()}


def test_precedence(spark):
    assert reasons(
        spark, [("node_modules/a.js", 1)], global_patterns=["node_modules/"], repo_patterns=["!node_modules/"]
    )["node_modules/a.js"] == (False, "repo_allow")
    assert reasons(spark, [("target/a", 1)], global_patterns=["!target/"], repo_patterns=["target/"])[
        "target/a"
    ] == (True, "repo_ignore")
    assert reasons(spark, [("x.log", 1)], include=["*.log"], gitignore=["*.log"])["x.log"] == (False, "include")


def test_heuristics(spark):
    rows = {
        "a/.git/config": "dir", "out/Cargo_Target_Cache/x": "build_cache", "a.backup.py": "backup", "a.py~": "backup",
        "b.BAK": "backup", "x.so": "extension", ".env": "hidden", "a/.h/b.py": "hidden",
        "vite.config.ts.timestamp-1.mts": "timestamp", "big.txt": "size", "nosize.txt": "size", "g.txt": "gitignore",
        "venv/a.py": "dir", "fine.py": "keep",
    }
    sizes = {"big.txt": 1_200_000, "nosize.txt": None}
    got = reasons(
        spark,
        [(p, sizes.get(p, 10)) for p in rows],
        skip_dirs=[".git", ".venv"],
        skip_extensions=[".so"],
        gitignore=["g.txt"],
    )
    assert {p: r for p, (_, r) in got.items()} == rows
    assert reasons(spark, [("big.txt", 1_200_000)], max_size=2_000_000)["big.txt"] == (False, "keep")


def test_event_prefilter(spark):
    df = spark.createDataFrame(
        [(p,) for p in ["git/x", ".git/x", "build/a", ".build/a", "src/a", "node_modules/k/z", "docs/a.md"]],
        "path string",
    )
    got = df.where(
        ~ignore.event_dropped(
            skip_dirs=[".git", "build", "node_modules"], gitignore=["*.md"], include=["node_modules/k/*"]
        )
    )
    assert {r.path for r in got.collect()} == {"src/a", "node_modules/k/z"}


def test_embed_policy(spark):
    import json

    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "raw", "source": "no"}]})
    rows = [
        ("n.ipynb", book, True), ("empty.ipynb", '{"cells": []}', False), ("bad.ipynb", "{", False),
        ("d.jsonl", '{"a": 1}', False), ("Cargo.lock", "x", False), ("package-lock.json", "{}", False),
        ("a.bak", "x", False), ("x.jsonl.txt", "y" * 10_001, False), ("x.jsonl.txt", "y" * 10_000, True),
        ("main.py", "x", True),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "i int, path string, text string")
    assert values(df, ignore.embed_allowed()) == [r[2] for r in rows]
    assert values(df, ignore.embed_text())[0] == "a\nb"


def test_allow_patterns():
    assert paths.allow_patterns(["python", "go"], ["*.log", "!**/*.go", " "]) == [
        "!**/*.go", "!**/*.py", "!**/*.pyi", "!**/*.pyw", "*.log",
    ]
    assert paths.allow_patterns([], ["x"]) == ["x"]


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("a.py", "", (True, False, False, False, ".py", "python")),
        ("a.json", "", (False, True, True, False, ".json", "unknown")),
        ("a.csv", "", (False, True, False, True, ".csv", "unknown")),
        ("a.jsonl", "", (False, False, False, True, ".jsonl", "unknown")),
        ("a.h", "@interface X", (True, False, False, False, ".h", "objective-c")),
        ("a.h", "std::string s;", (True, False, False, False, ".h", "cpp")),
        ("a.h", "int x;", (True, False, False, False, ".h", "c")),
        ("a.mm", "x", (True, False, False, False, ".mm", "objective-cpp")),
        ("build/a.py", "", (False, False, False, True, ".py", "python")),
        ("README", "see", (False, True, False, False, None, "unknown")),
        ("license.txt", "", (False, True, False, False, ".txt", "unknown")),
        ("run", "  #!/bin/sh", (True, False, False, False, None, None)),
        ("x", "def f", (True, False, False, False, None, None)),
        ("x", "undefined", (False, False, False, False, None, "unknown")),
        ("x", "a;b;c;d;{}", (True, False, False, False, None, None)),
        ("x.weird", "def f", (False, False, False, False, ".weird", "unknown")),
        ("x.pyx", "", (True, False, False, False, ".pyx", "unknown")),
    ],
)
def test_classify(spark, path, text, want):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    assert tuple(df.select(classify("path", "text").alias("c")).first().c) == want


def test_document_language(spark):
    df = spark.createDataFrame([(0, "a.RS"), (1, "b/c.yml"), (2, "Makefile")], "i int, path string")
    assert values(df, paths.language_of("path")) == ["rust", "yaml", "unknown"]
