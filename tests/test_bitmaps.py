import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import bitmaps, postings, search
from textquarry.operators.sizing import staged
from textquarry.session import run_folder


GRAMS = {
    "abc": "true",
    "two": "doc_id % 2 = 0",
    "ten": "doc_id % 10 = 0",
    "rar": "doc_id % 9973 = 0",
    "end": "doc_id > 69995",
}


def test_dense_numbers(spark):
    ids = [random.Random(2).randrange(-(10**12), 10**12) for _ in range(500)]
    df = spark.createDataFrame([(i,) for i in [*ids, *ids[:50], None]], "doc_id long").repartition(5)
    got = {r.doc_id: r.number for r in bitmaps.document_numbers(df).collect()}
    assert got == {d: n for n, d in enumerate(sorted(set(ids)), 1)}
    assert bitmaps.document_numbers(df.where("false")).collect() == []


@pytest.mark.parametrize("dense", [1, 6, 10**6])
def test_counts_and_intersections_over_buckets(spark, dense):
    """70 000 documents are three buckets; grams of every density, one in the last bucket only."""
    docs = spark.range(1, 70_001).withColumnRenamed("id", "doc_id")
    held = F.filter(
        F.array(*(F.when(F.expr(test), g) for g, test in GRAMS.items())), lambda x: x.isNotNull()
    )
    pairs = staged(docs.select((F.col("doc_id") * 3).alias("doc_id"), F.explode(held).alias("gram")), "test-pairs")
    index = bitmaps.build_bitmaps(pairs.unionByName(pairs.where("doc_id < 300")), run_folder(spark, "bitmaps"), dense=dense)
    numbers = {r.doc_id: r.number for r in index.numbers().collect()}
    want = {}
    for r in pairs.collect():
        at = (r.gram, 1 + (numbers[r.doc_id] - 1) // 32768)
        want[at] = want.get(at, 0) + 1
    assert {(r.gram, r.bucket): r.n_docs for r in index.sizes().collect()} == want
    asked = {1: ["abc", "two"], 2: ["two", "rar"], 3: ["abc", "non"], 4: ["end"], 5: ["rar", "end"], 6: ["abc", "two", "ten"]}
    table = spark.createDataFrame([(q, g) for q, gs in asked.items() for g in gs], "query_id int, gram string")
    got = {}
    for r in index.candidates(table).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    held = {}
    for r in pairs.collect():
        held.setdefault(r.gram, set()).add(r.doc_id)
    for q, grams in asked.items():
        assert sorted(got.get(q, [])) == sorted(set.intersection(*(held.get(g, set()) for g in grams)))


def test_search_through_bitmaps(spark, sample):
    texts = sample.unionByName(spark.createDataFrame([(9, "demo", "n.py", None), (10, "x", "e.py", "")], sample.schema))
    pairs = staged(postings.gram_pairs(texts), "test-pairs")
    index = bitmaps.build_bitmaps(pairs, run_folder(spark, "bitmaps"), dense=2)
    words = ["def ", "RETURN", "self.name", "no such", "ab", "print(", "e\nf", "item.strip()"]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id int, query string")
    key = lambda df: sorted(map(tuple, df.select("query_id", "repo", "path", "line", "text").collect()))
    want = key(search.search_many(texts, queries, method="scan"))
    assert want and key(index.search(texts, queries)) == want
    assert key(index.search(texts.where("path <> 'main.py'"), queries)) == [r for r in want if r[2] != "main.py"]
