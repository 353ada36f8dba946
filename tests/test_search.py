import tracemalloc

import pytest

from textquarry.operators import files as file_ops
from textquarry.operators import postings, search

TEXTS = {
    ("r1", "a.py"): "Hello World\n  say hello  \nbye",
    ("r1", "lib/b.rs"): "fn hello() {}\nHELLO again",
    ("r1", ".hid/c.rs"): "hello hidden",
    ("r2", "d.rs"): "nothing\r\nhel\nlo",
    ("r2", "e.md"): "",
    ("r2", "f.md"): "the HeLLo\u2028hello two",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, r, p, t) for i, ((r, p), t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")


def brute(query, keep=lambda r, p: True, fold=True):
    f = str.lower if fold else (lambda x: x)
    return sorted(
        (r, p, n, line.strip())
        for (r, p), t in TEXTS.items()
        if keep(r, p)
        for n, line in enumerate(t.splitlines(), 1)
        if f(query) in f(line)
    )


def hits(df):
    return sorted((r.repo, r.path, r.line, r.text) for r in df.collect())


@pytest.mark.parametrize("query", ["hello", "HELLO", "lo\nhel", "llo w", "hel", "he", "", "zzz", "the h"])
def test_search_is_brute_force(files, query):
    want = brute(query) if len(query) >= 3 else []
    assert hits(search.search_code(files, query, max_results=None)) == want
    pairs = postings.gram_pairs(files)
    for rarest in (None, 1, 2):
        got = search.search_postings(pairs, files, query, max_results=None, rarest=rarest)
        assert hits(got) == want


def test_repo_and_limit(files):
    assert hits(search.search_code(files, "hello", repo="r2")) == brute("hello", lambda r, p: r == "r2")
    assert hits(search.search_code(files, "hello", repo="nope")) == []
    assert hits(search.search_code(files, "hello", repo="nope", unknown_repo="all")) == brute("hello")
    with pytest.raises(ValueError):
        search.search_code(files, "hello", repo="nope", unknown_repo="error")
    first = search.search_code(files, "hello", max_results=2).collect()
    assert [(r.repo, r.path, r.line, r.doc_id) for r in first] == [
        ("r1", ".hid/c.rs", 1, "r1::.hid/c.rs"),
        ("r1", "a.py", 1, "r1::a.py"),
    ]


def test_search_repo(files):
    keep = lambda r, p: p.endswith(".rs") and "/." not in "/" + p
    assert hits(search.search_repo(files, "hello")) == brute("hello", keep, fold=False)
    assert hits(search.search_repo(files, "hello", file_glob="*")) == brute("hello", fold=False)
    with pytest.raises(ValueError):
        search.search_repo(files, "hello", repo="nope")
    ids = search.search_ids(files, "HELLO", file_glob="*.rs").collect()
    assert [tuple(r) for r in ids] == [
        ("r1::lib/b.rs", "r1:lib/b.rs (line 2)", "corpus://repos/r1::lib/b.rs")
    ]


@pytest.mark.parametrize("method", ["scan", "postings", "auto"])
def test_many_queries(spark, files, method):
    queries = ["hello", "hello", "o w", "he", "lo\nx", "zzz", "fn hello() {}", "HELLO two", "bye\n"]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = search.search_many(files, table, method=method).collect()
    want = sorted(
        (i, *h) for i, q in enumerate(queries) if len(q) >= 3 and "\n" not in q for h in brute(q)
    )
    assert sorted((r.query_id, r.repo, r.path, r.line, r.text) for r in got) == want


def test_many_without_queries(spark, files):
    empty = spark.createDataFrame([], "query_id int, query string")
    for method in ("scan", "postings"):
        assert search.search_many(files, empty, method=method).count() == 0


def test_postings(spark, files):
    pairs = postings.gram_pairs(files)
    want = {
        (i, t[k : k + 3])
        for i, t in enumerate(x.lower() for x in TEXTS.values())
        for k in range(len(t) - 2)
    }
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    lists = postings.posting_lists(pairs, 4).collect()
    assert {(d, r.gram) for r in lists for d in r.doc_ids} == want
    assert all(d * 40503 // 256 % 4 == r.segment and r.n_docs == len(r.doc_ids) for r in lists for d in r.doc_ids)
    gone = spark.createDataFrame([(0,), (1,)], "doc_id long")
    left = postings.remove_docs(pairs, gone)
    assert {tuple(r) for r in left.collect()} == {w for w in want if w[0] > 1}
    assert postings.merge_postings(left, pairs).count() == len(want)
    assert postings.empty_postings(pairs).count() == 0
    assert postings.gram_total(pairs).first()[0] == len({g for _, g in want})


def test_stale_grams(spark):
    old = spark.createDataFrame([(1, "abcde"), (2, "xyzw")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    got = postings.stale_grams(postings.gram_sets(old), postings.gram_sets(new))
    assert {tuple(r) for r in got.collect()} == {(1, "cde"), (2, "xyz"), (2, "yzw")}


def test_wide_characters_make_whole_grams(spark):
    df = spark.createDataFrame([(1, "\U0001f600ab\U0001f601")], "doc_id long, text string")
    assert {r.gram for r in postings.gram_pairs(df).collect()} == {"\U0001f600ab", "ab\U0001f601"}


def test_long_texts_are_cut_into_grams_in_parts(monkeypatch):
    text = "the quick brown f\u00f6x jumps \U0001f600 " * 40_000
    tracemalloc.start()
    postings._packed_grams(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)  # one array of the whole text's grams is as much
    monkeypatch.setattr(postings, "_PART", 4)
    texts = ["", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "h\u00e9\u4e2d\U0001f600\u0000\n\ud7ff" * 5, text[:99]]
    want = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts]
    assert [postings._gram_strings(postings._packed_grams(t)).to_pylist() for t in texts] == want


# --- listing, reading, registry -----------------------------------------------------------------------


def test_listing(spark):
    paths = ["a/b/c/d/e/f.py", "a/x.py", "r.py", ".h/y.py", "a/.h2/z.py", "a/.q", "b/.k/l/m.py"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")

    def entries(**kw):
        return [(r.type, r.path) for r in file_ops.list_entries(df, **kw).orderBy("type", "path").collect()]

    assert entries() == [
        ("dir", "a"), ("dir", "a/b"), ("dir", "a/b/c"), ("dir", "a/b/c/d"), ("dir", "a/b/c/d/e"), ("dir", "b"),
        ("file", "a/x.py"), ("file", "r.py"),
    ]
    assert ("file", "a/b/c/d/e/f.py") in entries(max_depth=5)
    assert entries(max_depth=0) == [("dir", "a"), ("dir", "b"), ("file", "r.py")]
    assert entries(subdir="a/b", max_depth=1) == [("dir", "a/b/c"), ("dir", "a/b/c/d")]
    assert ("file", "b/.k/l/m.py") in entries(include_hidden=True)
    assert entries(subdir="b/.k") == [("dir", "b/.k/l"), ("file", "b/.k/l/m.py")]
    assert len(entries(max_entries=3)) == 3
    assert entries(repo="other") == []


def test_reading_and_fetching(spark, files):
    wanted = spark.createDataFrame([("r1", "a.py"), ("r9", "x")], "repo string, path string")
    got = file_ops.read_files(files, wanted, max_bytes=5).collect()
    assert [r.text for r in got] == ["Hello\n\n[... truncated ...]"]
    ids = spark.createDataFrame([("r1::a.py",), ("r1::no::where",)], "id string")
    rows = {r.id: r for r in file_ops.fetch(files, ids).collect()}
    assert rows["r1::a.py"].text == TEXTS["r1", "a.py"] and rows["r1::a.py"].title == "r1:a.py"
    assert rows["r1::no::where"].text is None and rows["r1::no::where"].metadata.path == "no::where"
    with pytest.raises(Exception, match="invalid document id"):
        file_ops.fetch(files, spark.createDataFrame([("bad",)], "id string")).collect()


def test_registry(spark):
    old = spark.createDataFrame([("a", "/a", 1), ("b", "/b", 2)], "repo string, path string, indexed_at int")
    new = spark.createDataFrame([("b", "/B", 3), ("c", "/c", 4)], "repo string, path string, indexed_at int")
    merged = {tuple(r) for r in file_ops.upsert_repos(old, new).collect()}
    assert merged == {("a", "/a", 1), ("b", "/B", 3), ("c", "/c", 4)}
    kept = {tuple(r) for r in file_ops.upsert_repos(old, new, insert_only=True).collect()}
    assert kept == {("a", "/a", 1), ("b", "/b", 2), ("c", "/c", 4)}
    assert [r.repo for r in file_ops.list_repos(old).collect()] == ["a", "b"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_postings_travel_by_document(spark):
    old = spark.createDataFrame([("abc", 1), ("abc", 1), ("abd", 1), ("abc", None), ("abe", 2)], "gram string, doc_id long")
    new = spark.createDataFrame([("abc", 1), ("xyz", 1), ("abc", None), ("abc", 3)], "gram string, doc_id long")
    merged = postings.merge_postings(old, new)
    got = [tuple(r) for r in merged.collect()]
    assert len(got) == len(set(got)) == 6
    assert set(got) == {("abc", 1), ("abd", 1), ("xyz", 1), ("abc", None), ("abe", 2), ("abc", 3)}
    assert "hashpartitioning(gram" not in _plan(merged)  # a pair each


def test_posting_lists_are_folded_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(postings, "_BLOCK", 50)
    rows = [(g, d) for d in [*range(300), *range(0, 300, 7), None] for g in ("abc", "abd")]
    lists = postings.posting_lists(spark.createDataFrame(rows, "gram string, doc_id long"), 4)
    got = {}
    for r in lists.collect():
        assert r.doc_ids == sorted(set(r.doc_ids)) and r.n_docs == len(r.doc_ids)
        got.setdefault(r.gram, []).extend(r.doc_ids)
    assert {g: sorted(v) for g, v in got.items()} == {"abc": list(range(300)), "abd": list(range(300))}
    assert "collect_set" not in _plan(lists) and "MapInArrow" in _plan(lists)


def test_ordered_pairs_come_in_blocks_of_order(spark):
    docs = spark.createDataFrame([(i, f"Text {i} \U0001f600 of ab") for i in (9, 2, 5)] + [(4, None)], "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in postings.ordered_pairs(docs).collect()]
    assert got == sorted(got) and set(got) == {(r.gram, r.doc_id) for r in postings.gram_pairs(docs).collect()}


def test_candidates_meet_a_document_as_one_list(spark, files, monkeypatch):
    rows, stage = {}, search.staged

    def counted(df, name):
        out = stage(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(search, "staged", counted)
    asked = [(1, "hello"), (2, "say"), (3, "HELLO "), (4, "two"), (5, "ell"), (6, "hello")]
    table = spark.createDataFrame(asked, "query_id int, query string")
    extra = spark.createDataFrame([(6, "r3", "z", None), (7, "r3", "y", "so: say hello\n")], files.schema)
    every = files.unionByName(extra)

    def found(method):
        return sorted(map(tuple, search.search_many(every, table, method=method).collect()))

    scanned = found("scan")
    assert found("postings") == scanned and (2, "r3", "y", 1, "so: say hello") in scanned
    assert rows["candidates"] == 5  # ids 0, 1, 2, 5 and 7, however many queries each may hold
    monkeypatch.setattr(search, "NEEDLES", 2)
    assert found("postings") == scanned and rows["candidates"] > 5
