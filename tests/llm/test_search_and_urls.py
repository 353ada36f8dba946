import numpy as np

from textquarry.llm import url_rules, vector_search


def test_top_k_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(5, rows[5][1]), (5, rows[6][1])]
    rows += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, []), (905, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS block", "2 AS place")
    base = vector_search.integer_vectors(df, "vec_id", "embedding", 4)
    for bits in (1, 3, 8):
        got = vector_search.exact_top_k(base, base.where("id % 10 = 0"), 5, bits=bits, chunk=64, query_block=16).collect()
        plain = sorted({(i, tuple(int(np.floor(4 * x)) for x in v)) for i, v in rows[:382]})
        want = set()
        for q, a in plain:
            if q % 10:
                continue
            best = sorted({(-int(np.dot(a, b)), i) for i, b in plain if i != q})[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    v = vector_search.integer_vectors(df, "vec_id", "embedding", 1)
    assert [tuple(r) for r in vector_search.exact_top_k(v, v.where("id = 0")).collect()] == [(0, 1, 1, 11)]
    assert vector_search.exact_top_k(v.where("false"), v).collect() == []
    assert vector_search.exact_top_k(v, v.where("false")).collect() == []


URLS = [
    ("http://A.Example.org/es/x?q=/en/1", "block"), ("https://example.org/en/12", "block"), ("https://example.org/en/2", "allow"),
    ("http://notexample.org/es/", "allow"), ("http://x.com/de/1", "block"), ("http://x.com/fr/1#a", "allow"), ("http://com/de/", "block"),
    ("http://x.com", "allow"), ("no scheme", "allow"), (None, "allow"), ("", "allow"), ("a://b://c/de/", "allow"), ("http:///de/", "allow"),
    ("http://x.com.\n/de/", "allow"), ("x://" + "a." * 50 + "com/de/" + "y" * 3000, "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)] * 2 + [(None, "http://x.com/de/")], "page_id long, url string")
    pages = pages.selectExpr("*", "'other' AS rule", "'other' AS host", "'other' AS _url")
    rules = url_rules.rule_table(spark, url_rules.RULES)
    got = url_rules.filter_pages(pages, rules).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        assert r.verdict == ("block" if r.page_id is None else URLS[r.page_id][1]), r
    first = {r.page_id: r for r in got}
    assert (first[0].host, first[0].path, first[0].rule) == ("a.example.org", "/es/x", "example.org/es/")
    assert (first[9].host, first[9].path, first[9].rule) == ("", "", None)
    assert url_rules.filter_pages(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in url_rules.filter_pages(pages, rules.where("false")).collect()} == {"allow"}


def test_urls_meet_rules_on_short_prefixes_alone(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/")], "page_id long, url string")
    judged = url_rules.judge_urls(pages, url_rules.rule_table(spark, url_rules.RULES))
    joins = [x for x in judged._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in x or "MergeJoin" in x]
    assert len(joins) == 1 and "[_start" in joins[0] and "digest" not in joins[0] and "sha2" not in joins[0]


def test_hosts_of_very_many_labels(spark):
    many = "a." * 100_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{many}/es/x"), (2, "http://" + "." * 100_000 + "/de/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule, len(r.host)) for r in url_rules.filter_pages(pages, url_rules.rule_table(spark, url_rules.RULES)).collect()}
    assert got == {1: ("block", "example.org/es/", len(many)), 2: ("allow", None, 100_000)}
