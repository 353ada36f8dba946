import os

import pytest

from textquarry.operators import files as file_ops
from textquarry.operators import ignore, search
from textquarry.plans import index
from textquarry.sources import tree
from textquarry.sources.store import Store

FILES = {
    ".git/config": b"c", ".git/info/exclude": b"secret.txt\n", ".gitignore": b"# no\n\n*.log\n!keep.log\n", ".hidden": b"h",
    ".index_include": b"logs/a.log\n", "_priv/a.py": b"x = 1\n", "bad.py": b"\xff\xfe", "pkg/__init__.py": b"",
    "pkg/_helper.py": b"def h(): pass\n", "pkg/main.py": "é = 1\n".encode(), "logs/a.log": b"log", "logs/b.log": b"log",
    "keep.log": b"k", "secret.txt": b"s", "big.bin": b"0" * 5000,
}


@pytest.fixture
def roots(tmp_path):
    for p, b in FILES.items():
        f = tmp_path / "one" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "only.md").write_text("# two")
    return {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_every_file_once(spark, roots, partitions):
    rows = tree.list_tree(spark, roots, partitions).collect()
    want = {("one", p, len(b)) for p, b in FILES.items()} | {("two", "only.md", 5)}
    assert len(rows) == len(want) and {(r.repo, r.path, r.size) for r in rows} == want


def test_reading(spark, roots):
    read = tree.read_tree(tree.list_tree(spark, roots), max_bytes=1000).where("repo = 'one'")
    got = {r.path: r.content for r in read.collect()}
    assert got["big.bin"] is None
    assert {p: bytes(c) for p, c in got.items() if p != "big.bin"} == {
        p: b for p, b in FILES.items() if p != "big.bin"
    }
    text = {r.path: r for r in file_ops.decoded(read.where("path like '%.py'")).collect()}
    assert text["bad.py"].text == "\ufffd\ufffd" and text["bad.py"].size == 2
    assert text["pkg/main.py"].language == "python"


def test_files_that_vanish_are_left_empty(spark, roots):
    listing = tree.list_tree(spark, roots).where("path = 'keep.log'").cache()
    assert listing.count() == 1
    os.remove(os.path.join(roots["one"], "keep.log"))
    row = tree.read_tree(listing, tasks=1).first()
    assert row.content is None and row.error


def test_what_cannot_be_read_is_not_deleted(spark, roots, tmp_path):
    """A file that is there but not readable, or too large, stays as it is known."""
    store = Store(spark, str(tmp_path / "index"))
    texts = lambda **how: file_ops.decoded(tree.read_tree(tree.list_tree(spark, {"one": roots["one"]}), **how)).select("repo", "path", "text")
    index.index_repositories(store, texts())
    known = store.documents().count()
    assert known == len(FILES)
    totals = index.index_repositories(store, texts(max_bytes=1000)).collect()
    assert store.documents().count() == known and not any(r.files_removed for r in totals)
    changes = file_ops.detect_changes(store.documents(), texts(max_bytes=1000).selectExpr("*", "sha2(text, 256) AS blob_sha"))
    assert {r.path for r in changes.where("change = 'unreadable'").collect()} == {"big.bin"}


def test_folders_that_cannot_be_opened_are_passed_over(tmp_path):
    assert tree._entries(str(tmp_path / "gone")) == []


def test_rules_from_the_tree(spark, roots):
    listing = tree.list_tree(spark, roots)
    texts = file_ops.decoded(tree.read_tree(listing, max_bytes=1000)).select("repo", "path", "text")
    git = tree.pattern_table(texts)
    assert [r.pattern for r in git.orderBy("ord").collect()] == ["*.log", "!keep.log", "secret.txt"]
    include = tree.pattern_table(texts, tree.INCLUDE_FILES)
    got = {
        r.path: r.reason
        for r in ignore.with_table_decision(listing, git, include, max_size=1000).where("repo = 'one'").collect()
    }
    assert got == {
        ".git/config": "hidden", ".git/info/exclude": "hidden", ".gitignore": "hidden", ".hidden": "hidden",
        ".index_include": "hidden", "_priv/a.py": "keep", "bad.py": "keep", "pkg/__init__.py": "keep",
        "pkg/_helper.py": "keep", "pkg/main.py": "keep", "logs/a.log": "include", "logs/b.log": "gitignore",
        "keep.log": "keep", "secret.txt": "gitignore", "big.bin": "size",
    }
    hits = search.search_repo(texts.where("text is not null"), "def", file_glob="*.py").collect()
    assert [(r.path, r.line) for r in hits] == [("pkg/_helper.py", 1)]


def test_footprint(spark, roots):
    got = {r.repo: r.bytes for r in tree.tree_footprint(tree.list_tree(spark, roots)).collect()}
    assert got == {"one": sum(map(len, FILES.values())), "two": 5}


def test_tail_of_a_file_read_in_parts(spark, tmp_path):
    f = tmp_path / "server.log"
    f.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = tree.read_log(spark, str(f))
        assert log.rdd.getNumPartitions() > 5
        got = [r.text for r in tree.log_tail(log, 7, order=["file", "at", "row"]).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(4993, 5000)]


def test_log_tail(spark):
    assert [tree.clamp_tail(x) for x in ("5", 0, -3, 99999, "x", None)] == [5, 1, 1, 2000, 200, 200]
    log = spark.range(1, 301).selectExpr("id AS line", "concat('l', id) AS text")
    assert [r.line for r in tree.log_tail(log, 3).collect()] == [298, 299, 300]
    assert tree.log_tail(log, "bad").count() == 200
