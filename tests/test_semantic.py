import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import semantic

FLAGS = ("is_code", "is_doc", "is_config", "is_data")


@pytest.mark.parametrize(
    "args,size",
    [
        ((20,), 100), ((1,), 50), ((100,), 200), ((20, 30), 30), ((20, 5), 20), ((20, 900), 200),
        ((100, None, True), 500), ((100, None, False, True), 400), ((10, 10, True), 50),
    ],
)
def test_pool_size(args, size):
    assert semantic.pool_size(*args) == size


def test_rerank_weights(spark):
    rows = [
        (1, 0.4, True, False, False, False), (2, 0.2, False, True, False, False), (3, 0.2, False, True, True, False),
        (4, 0.2, False, False, True, True), (5, 0.2, False, False, False, True), (6, 0.2, True, True, False, False),
        (7, 0.0, True, False, False, False), (8, 0.2, False, False, False, False), (9, 0.2, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, distance double, " + ", ".join(f"{f} boolean" for f in FLAGS))
    near = 1 / 1.2
    plain = {r.id: r.score for r in semantic.rerank(df).collect()}
    assert plain == pytest.approx(
        {1: 1.05 / 1.4, 2: near * 0.85, 3: near * 0.85, 4: near * 0.9, 5: near * 0.9, 6: near * 0.85, 7: 1.0,
         8: near, 9: near * 1.05}
    )
    code = {r.id: r.score for r in semantic.rerank(df, prefer_code=True).collect()}
    assert code == pytest.approx(
        {1: 1.2 / 1.4, 2: near * 0.8, 3: near * 0.8, 4: near * 0.85, 5: near * 0.9, 6: 1.0, 7: 1.0, 8: near, 9: 1.0}
    )
    assert {r.id: r.language_authoritative for r in semantic.rerank(df).collect()}[9] is True


def cloud(spark, n, repos, seed=1, dim=8, hot=0.0):
    """Random vectors with copies; a share ``hot`` of them is one vector in one repo."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 3), dim)).astype("float32")
    rows = []
    for i in range(n):
        if i < n * hot:
            rows.append((i, "hot", base[0].tolist(), True, False, False, False))
        else:
            v = base[rng.integers(len(base))]
            flags = [bool(x) for x in rng.integers(0, 2, 4)]
            rows.append((i, f"r{rng.integers(repos)}", v.tolist(), *flags))
    schema = "chunk_id long, repo string, vector array<float>, " + ", ".join(f"{f} boolean" for f in FLAGS)
    return spark.createDataFrame(rows, schema).repartition(6), rows


def brute_pool(rows, query, pool):
    out = {}
    q = np.array(query) / np.linalg.norm(query)
    for i, repo, v, *_ in rows:
        v = np.array(v, dtype="float64")
        out.setdefault(repo, []).append((round(1 - float(v @ q / (np.linalg.norm(v) or 1)), 9), i))
    return {(repo, i) for repo, ds in out.items() for _, i in sorted(ds)[:pool]}


@pytest.mark.parametrize("pool", [1, 7, 50, 1200])
def test_nearest_with_a_hot_repo_of_copies(spark, pool, monkeypatch):
    if pool > 1000:
        monkeypatch.setattr(semantic, "_GROUP_LIMIT", 1000)
    chunks, rows = cloud(spark, 3000, 4, hot=0.4)
    asked = [np.ones(8).tolist(), np.arange(8).astype(float).tolist()]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, vector array<double>")
    got = semantic.nearest(chunks, queries, pool).collect()
    for j, q in enumerate(asked):
        assert {(r.repo, r.chunk_id) for r in got if r.query_id == j} == brute_pool(rows, q, pool)


@pytest.mark.parametrize("limits", [{"QUERIES_PER_PASS": 5}, {"_FEW_ROWS": 0, "_PASS_ROWS": 60}])
def test_more_queries_than_a_pass_holds(spark, monkeypatch, limits):
    chunks, rows = cloud(spark, 300, 3)
    rng = np.random.default_rng(5)
    asked = rng.normal(size=(23, 8))
    queries = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<double>"
    )
    for name, value in limits.items():
        monkeypatch.setattr(semantic, name, value)
    got = semantic.nearest(chunks, queries, 4).collect()
    for j, q in enumerate(asked):
        assert {(r.repo, r.chunk_id) for r in got if r.query_id == j} == brute_pool(rows, q, 4)


def test_modes_and_errors(spark):
    chunks, rows = cloud(spark, 200, 3)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "query_id int, vector array<double>")
    top = semantic.semantic_search(chunks, queries, k=5)
    assert top.count() == 5
    only = semantic.semantic_search(chunks, queries, k=5, code_only=True).collect()
    assert all(r.is_code for r in only) and len(only) == 5
    one = semantic.semantic_search(chunks, queries, k=5, repo="r1").collect()
    assert {r.repo for r in one} == {"r1"}
    # Code only filters the pool after it is cut: few candidates may leave fewer than k.
    few = semantic.semantic_search(chunks, queries, k=1, repo="r1", candidate_limit=1, code_only=True)
    assert few.count() <= 1
    with pytest.raises(ValueError):
        semantic.semantic_search(chunks, queries, repo="nope")
    assert semantic.semantic_search(chunks.where("false"), queries).count() == 0
    assert semantic.semantic_search(chunks, queries.where("false")).count() == 0


def test_odd_vectors(spark):
    rows = [(1, "r", [1.0, 0.0]), (2, "r", [0.0, 0.0]), (3, "r", [1.0]), (4, "r", None), (5, "r", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, repo string, vector array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, vector array<double>")
    got = {r.chunk_id: r.distance for r in semantic.nearest(df, queries, 10).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}


def test_groups_are_cut_before_the_shuffle(spark):
    chunks, _ = cloud(spark, 200, 3)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "query_id int, vector array<double>")
    plan = semantic.nearest(chunks, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_moves(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "a", "q")], "doc_id long, repo string, path string")
    moves = spark.createDataFrame([(2, "b", "z")], "doc_id long, repo string, path string")
    assert {tuple(r) for r in semantic.move_metadata(rows, moves).collect()} == {(1, "a", "p"), (2, "b", "z")}
    known = spark.createDataFrame([("a",)], "repo string")
    moved = semantic.move_metadata(rows, moves)
    assert [tuple(r) for r in semantic.alignment(moved, known).collect()] == [("b", 1)]
    assert moved.where(F.col("repo") == "b").count() == 1


def test_partitions_pass_on_pools_only(spark):
    """However repos are mixed in batches, a partition sends no more than the pool of each."""
    df, rows = cloud(spark, 3000, 200)
    df = df.repartition(3)
    asked = spark.createDataFrame([(q, rows[q][2]) for q in range(5)], "query_id int, vector array<float>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        scored = semantic._score(df, asked, 2, "vector", ("chunk_id",))
        per_group = scored.groupBy(F.spark_partition_id().alias("p"), "query_id", "repo").count()
        assert scored.count() <= 3 * 200 * 5 * 2 and per_group.where("count > 2").count() == 0
        got = {}
        for r in semantic.nearest(df, asked, 2).collect():
            got.setdefault(r.query_id, set()).add(r.chunk_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for q in range(5):
        assert got[q] == {i for _, i in brute_pool(rows, rows[q][2], 2)}
