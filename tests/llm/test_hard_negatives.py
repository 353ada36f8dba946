import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, step, scale, positives=5, negatives=3, low=50, high=95):
    """The contract read literally: rows is a set of (id, label, vector of integers)."""
    out = set()
    for a, label, v in rows:
        if a % step:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(score(w), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        for p, p_id, _ in sorted((x for x in others if x[2] == label), key=lambda x: (-x[0], x[1]))[:positives]:
            fit = sorted((-s, i) for s, i, other in others if other != label and low * p <= 100 * s <= high * p)
            out |= {(a, p_id, r, i, p, -s) for r, (s, i) in enumerate(fit[:negatives], 1)}
    return out


def whole(rows, scale):
    first = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, tuple(int(np.floor(scale * x)) for x in v))
        first[i] = min(first.get(i, key), key)
    return {(i, label, v) for i, (label, v) in first.items()}


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-1, 5, 6).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(260)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(90)] + [(2000 + i, rows[1][1], 1) for i in range(40)]
    rows += [(10, rows[20][1], 2), (10, rows[20][1], 2), (20, rows[3][1], 0), (30, [0.0] * 6, 1), (40, [-2.0] * 6, 1)]
    rows += [(900, None, 1), (910, [1.0, None] * 3, 1), (920, [float("nan")] * 6, 1), (930, [float("inf")] * 6, 1), (940, [], 1)]
    rows += [(None, [1.0] * 6, 1), (950, [1.0] * 6, None), (960, [3.0], 0), (970, [2.0], 0), (980, [2.0], 1), (990, [1.0, 2.0], 5)]
    return rows


def test_all_windows_with_ties_copies_and_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS id", "1 AS v", "2 AS slot", "3 AS block")
    vectors = hn.labelled_vectors(df, "vec_id", "embedding", F.col("label"), 2)
    anchors = vectors.where("id % 10 = 0")
    want = brute(whole(rows, 2), 10, 2)
    assert len(want) > 300
    for sizes in ({"chunk": 16, "block": 4, "pass_bytes": 500}, {"chunk": 1000, "block": 1000}):
        got = [tuple(r) for r in hn.hard_negatives(vectors, anchors, **sizes).collect()]
        assert set(got) == want and len(got) == len(want)


def test_other_limits_and_counts(spark):
    rows = odd_rows()[:120]
    vectors = hn.labelled_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"), 2)
    kind = {"positives": 9, "negatives": 2, "low": -40, "high": 130}
    got = [tuple(r) for r in hn.hard_negatives(vectors, vectors.where("id % 10 = 0"), **kind).collect()]
    assert set(got) == brute(whole(rows, 2), 10, 2, **kind) and len(got) == len(set(got))


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e7] * 4, 0), (1, [3.0e7] * 4, 0), (2, [2.0e7, 2.0e7, 2.0e7, 2.0e7 + 1], 1), (3, [2.0e7] * 4, 1)]
    vectors = hn.labelled_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"), 1)
    got = [tuple(r)[3:] for r in hn.hard_negatives(vectors, vectors.where("id = 0")).orderBy("rank").collect()]
    assert got == [(2, 3600 * 10**12, 2400 * 10**12 + 3 * 10**7), (3, 3600 * 10**12, 2400 * 10**12)]


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 1)], SCHEMA)
    vectors = hn.labelled_vectors(rows, "vec_id", "embedding", F.col("label"))
    for v, a in ((vectors, vectors), (vectors.where("false"), vectors), (vectors, vectors.where("false")), (vectors.where("id = 0"), vectors)):
        assert hn.hard_negatives(v, a).collect() == []
