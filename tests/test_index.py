import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions.vectors import hashing_embedder
from textquarry.operators import files as file_ops
from textquarry.operators import postings, reports, search, semantic, symbols
from textquarry.plans import index, vector_index
from textquarry.sources.store import Store

SCHEMA = "repo string, path string, text string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"))


def table(spark, rows):
    return spark.createDataFrame([(r, p, t) for (r, p), t in rows.items()], SCHEMA)


FIRST = {
    ("a", "x.py"): "def one():\n    pass\n",
    ("a", "y.py"): "class Y:\n    def run(self):\n        pass\n",
    ("b", "x.py"): "def one():\n    pass\n",
    ("b", "z.md"): "# Title\nbody text\n",
}
LATER = {
    ("a", "x.py"): "def two():\n    pass\n",
    ("a", "y.py"): FIRST["a", "y.py"],
    ("b", "x.py"): FIRST["b", "x.py"],
    ("b", "n.py"): "def fresh():\n    pass\n",
}


def state(store):
    docs = store.documents()
    names = docs.select("doc_id", "repo", "path")
    return {
        "documents": {(r.repo, r.path, r.blob_sha, r.size, r.language) for r in docs.collect()},
        "files": {(r.repo, r.path, r.text) for r in store.files().collect()},
        "postings": sorted(
            (r.repo, r.path, r.gram) for r in store.live("postings").join(names, "doc_id").collect()
        ),
        "symbols": sorted(
            (r.repo, r.path, r.name, r.kind, r.line)
            for r in store.live("symbols").join(names, "doc_id").collect()
        ),
        "blobs": sorted(r.text for r in store.blobs().collect()),
    }


def totals(df):
    return {r.repo: (r.files_indexed, r.files_removed) for r in df.collect()}


def test_empty_store(store):
    assert store.documents().count() == 0 and store.live("postings").count() == 0
    assert [store.reserve(), store.reserve()] == [0, 1]


def test_full_then_incremental_equals_rebuild(spark, store, tmp_path):
    assert totals(index.index_repositories(store, table(spark, FIRST))) == {"a": (2, 0), "b": (2, 0)}
    got = index.index_repositories(store, table(spark, LATER))
    assert totals(got) == {"a": (1, 0), "b": (1, 1)}
    fresh, _ = index.rebuild(store, str(tmp_path / "fresh"), table(spark, LATER))
    assert state(store) == state(fresh)
    assert {(r, p): t for r, p, t in state(store)["files"]} == LATER
    embedded, _ = index.rebuild(
        store, str(tmp_path / "embedded"), table(spark, LATER), lambda: hashing_embedder(8), dim=8
    )
    assert state(embedded) == state(fresh) and embedded.live("vectors").count() == len(LATER)
    again = index.index_repositories(store, table(spark, LATER))
    assert again.count() == 0
    assert state(store) == state(fresh)
    small = store.compact(str(tmp_path / "small"))
    assert state(small) == state(fresh)
    assert small.log("postings").count() == store.live("postings").count()


def test_back_to_an_earlier_text(spark, store):
    for rows in (FIRST, LATER, FIRST):
        index.index_repositories(store, table(spark, rows))
    assert {(r, p): t for r, p, t in state(store)["files"]} == FIRST
    assert len(state(store)["postings"]) == len(set(state(store)["postings"]))


def test_one_repo_leaves_the_other_alone(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    index.index_repositories(store, table(spark, LATER), repos=["a"])
    files = {(r, p): t for r, p, t in state(store)["files"]}
    assert files["a", "x.py"] == LATER["a", "x.py"] and ("b", "z.md") in files
    assert ("b", "n.py") not in files


def test_force_takes_everything_again(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    before = state(store)
    got = index.index_repositories(store, table(spark, FIRST), force=True)
    assert totals(got) == {"a": (2, 0), "b": (2, 0)}
    assert state(store) == before


def test_changes_may_be_applied_twice(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    changed = table(spark, {k: v for k, v in LATER.items() if FIRST.get(k) != v})
    removed = spark.createDataFrame([("b", "z.md"), ("b", "never")], "repo string, path string")
    index.apply_changes(store, changed, removed, batch=1)
    once = state(store)
    index.apply_changes(store, changed, removed, batch=1)
    assert state(store) == once
    assert {(r, p): t for r, p, t in once["files"]} == LATER


def test_a_half_written_batch_is_not_seen(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    before = state(store)
    store.write("postings", 1, store.live("postings"))
    store.write("symbols", 1, store.live("symbols"))
    assert state(store) == before


def test_remove_files(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    asked = spark.createDataFrame([("a", "x.py"), ("a", "nope"), ("b", "z.md")], "repo string, path string")
    got = {(r.repo, r.path): r.removed for r in index.remove_files(store, asked).collect()}
    assert got == {("a", "x.py"): True, ("a", "nope"): False, ("b", "z.md"): True}
    left = state(store)
    assert {f[:2] for f in left["files"]} == {("a", "y.py"), ("b", "x.py")}
    # The text of a/x.py is still used by b/x.py, that of b/z.md by nobody.
    assert left["blobs"] == sorted([FIRST["a", "y.py"], FIRST["b", "x.py"]])
    assert file_ops.orphan_blobs(store.log("blobs"), store.documents()).count() == 1


def test_search_over_the_store(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    got = search.search_postings(store.live("postings"), store.files(), "DEF ONE")
    assert [(r.repo, r.path, r.line) for r in got.collect()] == [("a", "x.py", 1), ("b", "x.py", 1)]
    index.index_repositories(store, table(spark, LATER))
    for query in ("def one", "pass", "def fresh", "body text", "xy", "nowhere"):
        plain = search.search_code(store.files(), query).collect()
        assert index.search_store(store, query).collect() == plain
    hit = symbols.find_symbol(store.live("symbols"), store.documents(), "run").collect()
    assert [(r.file_path, r.kind, r.scope) for r in hit] == [("a::y.py", "member", "Y")]


# --- vectors ----------------------------------------------------------------------------------------------


def test_vector_build_and_search(spark, store):
    index.index_repositories(store, table(spark, FIRST | {("b", "d.jsonl"): '{"text":"x"}'}))
    make = lambda: hashing_embedder(32)
    stats = vector_index.build_vectors(store, make, 1, dim=32).first()
    assert (stats.chunks_indexed, stats.documents_processed) == (4, 4)
    vectors = store.live("vectors")
    assert {(r.path, r.is_code, r.is_doc, r.language) for r in vectors.collect()} == {
        ("x.py", True, False, "python"), ("y.py", True, False, "python"), ("z.md", False, True, "unknown"),
    }
    stale = {(r.path, r.error) for r in reports.stale_documents(store.documents()).collect()}
    assert stale == {("d.jsonl", "embed_skipped_by_policy")}
    assert len(state(store)["postings"]) > 0
    asked = semantic.embed_queries(
        spark.createDataFrame([(1, "title body text")], "query_id int, query string"), hashing_embedder(32)
    )
    got = semantic.semantic_search(vectors, asked, k=2, order=("path", "chunk_index")).orderBy(F.desc("score"))
    assert got.first().path == "z.md"
    # An edited file loses its vectors until they are built again.
    index.apply_changes(
        store, table(spark, {("b", "z.md"): "# New\n"}), spark.createDataFrame([], "repo string, path string")
    )
    assert "z.md" not in {r.path for r in store.live("vectors").collect()}
    assert ("z.md", None) in {(r.path, r.error) for r in reports.stale_documents(store.documents()).collect()}
    vector_index.build_vectors(store, make, store.reserve(), repo="b", dim=32)
    assert store.live("vectors").where("path = 'z.md'").count() == 1
    assert store.live("vectors").where("repo = 'a'").count() == 2
    with pytest.raises(ValueError):
        vector_index.build_vectors(store, make, 9, repo="nope", dim=32)


def test_wrong_vectors_are_refused_by_document(spark):
    rows = [(1, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    got = semantic.usable_vectors(df, 2).collect()
    assert sorted((r.doc_id, [round(x, 4) for x in r.vector]) for r in got) == [(1, [0.0, 0.0]), (1, [0.6, 0.8])]
    errors = {r.doc_id: r.vector_index_error for r in semantic.vector_errors(df, 2).collect()}
    assert errors == {2: "vector_upsert_failed", 3: "embeddings_unavailable"}
    audit = {(r.dim, r.vectors, r.matches) for r in semantic.dimension_audit(df.na.drop(), 2).collect()}
    assert audit == {(2, 3, True), (1, 1, False)}


def test_embedding_goes_back_to_its_rows(spark):
    from textquarry.functions.vectors import embedder

    texts = ["aaaa", "b", "ccc", "", "dd" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    lengths = embedder(lambda: lambda ts: np.array([[len(t), 1] for t in ts]), batch=2)
    got = df.select("i", lengths("text").alias("v")).orderBy("i").collect()
    assert [r.v[0] for r in got] == [len(t) for t in texts]
    short = embedder(lambda: lambda ts: np.zeros((1, 2)), batch=2)
    with pytest.raises(Exception, match="one vector per text"):
        df.select(short("text")).collect()


def test_embedding_holds_the_strings_of_one_model_batch():
    import tracemalloc

    import pyarrow as pa

    from textquarry.functions.vectors import embedder

    def model(texts):
        if texts[0] == "":
            raise RuntimeError("model down")
        return np.array([[len(t), np.nan] for t in texts])

    texts = pa.array([None, *(f"{i:05d}" * 2_000 for i in range(2_000))])
    embed = embedder(lambda: model, batch=1, on_error="null").func
    tracemalloc.start()
    (got,) = embed(iter([texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [None, *[[10_000.0, None]] * 2_000]  # NaN of a model comes as null
    assert peak < 5_000_000  # all texts as strings have 20 MB


def test_a_failing_model_marks_its_documents(spark, store):
    index.index_repositories(store, table(spark, FIRST))

    def flaky(texts):
        if any("Title" in t for t in texts):
            raise RuntimeError("model down")
        return np.ones((len(texts), 4))

    vector_index.build_vectors(store, lambda: flaky, 1, dim=4)
    stale = {(r.repo, r.path): r.error for r in reports.stale_documents(store.documents()).collect()}
    assert stale[("b", "z.md")] == "embeddings_unavailable"
    with pytest.raises(Exception, match="model down"):
        vector_index.build_vectors(store, lambda: flaky, 2, dim=4, on_error="raise")


def test_mean_pool(spark):
    rows = [(1, [1.0, 3.0]), (1, [3.0, 5.0]), (1, [9.0]), (2, [7.0]), (3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, vector array<float>")
    got = {r.k: (r.vector, r.segments) for r in semantic.mean_pool(df, ["k"], 2).collect()}
    assert got == {1: ([2.0, 4.0], 2), 3: ([2.0, 2.0], 1)}
    odd = {r.k: r.vector for r in semantic.mean_pool(df, ["k"], 2, count_mismatched=True).collect()}
    assert odd[1] == pytest.approx([4 / 3, 8 / 3])


# --- reports ------------------------------------------------------------------------------------------------


def test_reports(spark, store):
    index.index_repositories(store, table(spark, FIRST))
    docs, names = store.documents(), store.live("symbols")
    repos = docs.select("repo").distinct().withColumn("indexed_at", F.lit("t"))
    one = reports.index_stats(repos, docs, names, store.live("postings")).first()
    assert (one.repositories, one.documents, one.symbols) == (2, 4, 5)
    per = {r.repo: (r.documents, r.symbols) for r in reports.repo_index_stats(repos, docs, names).collect()}
    assert per == {"a": (2, 3), "b": (2, 2)}
    with pytest.raises(ValueError):
        reports.repo_index_stats(repos, docs, names, "nope")
    rows = {r.repo: r for r in reports.repo_stats(docs, names, store.live("vectors"), docs).collect()}
    assert rows[None].documents == 4 and rows["a"].vectors_stale == 2 and rows["b"].vectors == 0
    assert reports.stale_page(docs, 2, per_page=3).count() == 1
    runs = index.run_stats(store, 0)
    assert reports.run_totals(runs).first().files_indexed == 4
    assert reports.top_dirs(docs, 2).count() == 2
    assert postings.gram_counts(store.live("postings")).where("gram = 'def'").first().n_docs == 3
