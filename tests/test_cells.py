import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import cells, semantic
from textquarry.session import run_folder

SCHEMA = "chunk_id long, repo string, vector array<float>, is_code boolean"


def clustered(n=3000, dim=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 3
    rows = []
    for i in range(n):
        v = centers[i % groups] + rng.normal(size=dim) * 0.2
        rows.append((i, f"r{i % 5}", [float(x) for x in v], i % 5 == 0))
    return rows, centers


def chunk_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.selectExpr("*", "chunk_id % 7 = 0 AS is_doc", "false AS is_config", "chunk_id % 3 = 0 AS is_data")


def found(df):
    return sorted((r.query_id, r.repo, r.chunk_id, r.distance) for r in df.select("query_id", "repo", "chunk_id", "distance").collect())


@pytest.fixture(scope="module")
def world(spark):
    rows, centers = clustered()
    rows += [(5000 + i, "r1", rows[7][2], True) for i in range(60)]  # copies tie
    rows += [(6000, "r0", [0.0] * 16, None), (6001, "r0", [1.0] * 3, None), (6002, "r2", None, None), (6003, "tiny", rows[0][2], True)]
    chunks = chunk_table(spark, rows)
    queries = [(i, [float(x) for x in c]) for i, c in enumerate(centers[:6])] + [(90, rows[7][2]), (91, [0.0] * 16), (92, [-x for x in rows[0][2]])]
    asked = spark.createDataFrame(queries, "query_id int, vector array<double>")
    index = cells.build_cells(chunks, run_folder(spark, "cells"), cells=24, sample=1000)
    return chunks, asked, index


@pytest.mark.parametrize("pool", [1, 7, 40, 5000])
def test_same_pools_as_the_exact_scan(world, pool):
    chunks, asked, index = world
    assert found(index.nearest(asked, pool)) == found(semantic.nearest(chunks, asked, pool))


def test_cells_are_left_out(world):
    chunks, asked, index = world
    read = index.visits(asked.where("query_id < 6"), 10).where("repo <> 'tiny'").collect()
    assert len(read) == 30
    total, seen = sum(r.vectors for r in read), sum(r.vectors_read for r in read)
    assert seen < 0.2 * total and all(0 < r.cells_read < r.cells for r in read)


def test_search_through_the_index(world):
    chunks, asked, index = world
    for options in ({}, {"code_only": True, "k": 4}, {"repo": "r1", "k": 3}):
        want = semantic.semantic_search(chunks, asked, **options)
        got = semantic.semantic_search(chunks, asked, index=index, **options)
        key = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
        assert key(got) == key(want)
    with pytest.raises(ValueError, match="unknown repo"):
        semantic.semantic_search(chunks, asked, repo="none", index=index)


def test_rows_that_come_later(spark, world):
    chunks, asked, _ = world
    early, late = chunks.where("chunk_id % 4 <> 0"), chunks.where("chunk_id % 4 = 0")
    index = cells.build_cells(early, run_folder(spark, "cells"), cells=9, sample=500)
    index.add(late)
    assert found(index.nearest(asked, 12)) == found(semantic.nearest(chunks, asked, 12))


def test_more_passes_of_queries(world, monkeypatch):
    chunks, asked, index = world
    monkeypatch.setattr(cells, "QUERIES_PER_PASS", 4)
    assert found(index.nearest(asked, 5)) == found(semantic.nearest(chunks, asked, 5))


def test_empty_and_odd_tables(spark, world):
    _, asked, index = world
    none = spark.createDataFrame([], SCHEMA)
    empty = cells.build_cells(none, run_folder(spark, "cells"))
    assert empty.nearest(asked, 3).collect() == []
    assert index.nearest(asked.where("false"), 3).collect() == []
    odd = spark.createDataFrame([(1, "r", [0.0] * 16, True), (2, "r", None, True)], SCHEMA)
    lone = cells.build_cells(odd, run_folder(spark, "cells"))
    assert found(lone.nearest(asked, 3)) == found(semantic.nearest(odd, asked, 3))
    with pytest.raises(ValueError, match="length"):
        index.nearest(spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>"), 3)


def test_index_of_a_store(spark):
    """Removed files leave the pools, though the cells still count their vectors."""
    from textquarry.functions.vectors import hashing_embedder
    from textquarry.plans import index, vector_index
    from textquarry.sources.store import Store

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    texts = [(f"r{i % 2}", f"d{i}.py", "\n".join(" ".join(rng.choice(words[i % 5 * 8 : i % 5 * 8 + 8], 6)) for _ in range(4))) for i in range(60)]
    store = Store(spark, run_folder(spark, "cell-store"))
    index.index_repositories(store, spark.createDataFrame(texts, "repo string, path string, text string"))
    vector_index.build_vectors(store, lambda: hashing_embedder(16), 1, dim=16)
    vector_index.index_vectors(store, "a", cells=5)
    asked = spark.createDataFrame([("w0 w1 w2",), ("w17 w20",)], "query string").withColumn("query_id", F.monotonically_increasing_id())
    asked = semantic.embed_queries(asked, hashing_embedder(16))

    def both():
        key = lambda df: sorted((r.query_id, r.repo, r.path, r.chunk_index, round(r.score, 6)) for r in df.collect())
        options = {"k": 5, "candidate_limit": 5}
        got = key(vector_index.search_vectors(store, asked, "a", **options))
        assert got == key(vector_index.search_vectors(store, asked, **options)) and len(got) == 10
        return got

    before = both()
    gone = spark.createDataFrame([(r[1], r[2]) for r in before if r[0] == before[0][0]], "repo string, path string")
    index.remove_files(store, gone)
    assert not {r[2] for r in both() if r[0] == before[0][0]} & {r[2] for r in before if r[0] == before[0][0]}
