import itertools
import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths
from textquarry.operators import ignore, rule_index
from textquarry.operators.rule_index import keys_of

PATHS = [
    "a", "b.py", "a/b.py", "a/b/c.log", "x/a/b/c.tar.gz", "build", "build/x.py", "src/build/x.py", "src/build", "src/rebuild/x", ".hidden", "a/.git/config",
    "a.d/b.d", "src/a.egg-info/x", "a//b.py", "/a/b", "a/", "", "b.tar.gz/c", "été/ü.py", "a\nb/c.log", "*.egg-info/x", "a/b.py/b.py", ".gz", "x.", "..py",
]
CORES = ["a", "b.py", "a/b.py", "build", "src/build", "*.py", "*.gz", "*.tar.gz", "**/b.py", "**/*.py", "build/*", "build/**", "a/b/*", "*.egg-info", "?.py", "a*", "*", "**", "[ab].py", "**/build", "a/*.py", "*~", ".hidden", "*.", "**/a/**", ""]
PATTERNS = sorted({lead + core + end for core in CORES for lead in ("", "/") for end in ("", "/")} - {""})


def test_most_patterns_are_keys():
    assert [p for p in ("/a/b.py", "node_modules/", "*.log", "!x"[1:], "**/*.py", "**/x", "build/*", "/out/**") if not keys_of(p)] == []
    assert [keys_of(p) for p in ("a*b", "?.py", "[ab]", "*~", "a/*.py")] == [None] * 5
    assert keys_of("*.log", strict=True) and keys_of("a/**", strict=True) and keys_of("a/*", strict=True) is None


@pytest.mark.parametrize("strict", [False, True])
def test_every_pattern_alone(spark, strict):
    """A repo for each pattern: what its keys or its glob take is what its expression takes."""
    files = spark.createDataFrame([(f"p{i}", p) for i in range(len(PATTERNS)) for p in PATHS], "repo string, path string")
    rules = spark.createDataFrame([(f"p{i}", 0, p) for i, p in enumerate(PATTERNS)], "repo string, ord int, pattern string")
    got = {(r.repo, r.path) for r in rule_index.last_rule(files, rules, strict=strict).collect()}
    tree = spark.createDataFrame([(p,) for p in PATHS], "path string")
    hits = tree.select("path", *[paths.pattern_match("path", p, strict=strict).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    want = {(f"p{i}", r.path) for r in hits for i in range(len(PATTERNS)) if r[f"p{i}"]}
    assert got == want


def test_last_match_wins_over_long_lists(spark):
    rnd = random.Random(5)
    dirs = [f"d{i}" for i in range(6)]
    there = sorted({"/".join([*rnd.choices(dirs, k=rnd.randint(0, 4)), f"f{rnd.randint(0, 20)}.{rnd.choice(['py', 'js', 'tar.gz'])}"]) for _ in range(200)})
    pieces = ["/d1/f3.py", "f3.py", "d2/", "*.js", "**/f7.py", "d3/*", "/d0/d1/", "f1*.py", "d?/f5.py", "d4/d5", "*.gz", "/f9.py"]
    rules = {r: [("!" if rnd.random() < 0.4 else "") + rnd.choice(pieces) for _ in range(rnd.randint(1, 60))] + [""] for r in ("a", "b", "c")}
    files = spark.createDataFrame([(r, p) for r in [*rules, "none"] for p in there] * 2, "repo string, path string").repartition(3)
    table = spark.createDataFrame([(r, i, p) for r, ps in rules.items() for i, p in enumerate(ps)], "repo string, ord int, pattern string")
    got = {(r.repo, r.path): r.hit for r in rule_index.with_rule_match(files, table, "hit").collect()}
    assert len(got) == 4 * len(there)
    tree = spark.createDataFrame([(p,) for p in there], "path string")
    for repo, patterns in rules.items():
        want = {r.path: r.hit for r in tree.select("path", paths.last_match("path", patterns).alias("hit")).collect()}
        assert {p: got[repo, p] for p in there} == want
    assert not any(got["none", p] for p in there)
    listed = ignore.with_table_decision(files.withColumn("size", F.lit(1)), table, table.where("repo = 'a' AND ord < 3"))
    keyed = rule_index.with_rules_decision(files.withColumn("size", F.lit(1)), table, table.where("repo = 'a' AND ord < 3"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, keyed.collect()))


def test_no_expression_per_row_and_few_keys_of_a_deep_path(spark):
    rules = spark.createDataFrame([("r", i, f"d/{i}.py") for i in range(1200)] + [("r", 2000, "*.a.b")], "repo string, ord int, pattern string")
    deep = "/".join(["d"] * 20_000) + "/7.py"
    files = spark.createDataFrame([("r", deep), ("r", "." * 20_000), ("r", None), (None, "d/1.py"), ("r", "x.a.b")], "repo string, path string")
    last = rule_index.last_rule(files, rules)
    assert {(len(r.path), r.ord) for r in last.collect()} == {(len(deep), 7), (5, 2000)}
    plan = last._jdf.queryExecution().toString()
    assert "RLIKE" not in plan and "Join" in plan


def test_globs_meet_only_paths_with_their_literal(spark):
    """As many globs as files: the expressions tried do not grow with their product."""
    assert [rule_index.literal_of(p) for p in ("?[!x]/doc_8*.*", "a*bcd", "[ab].py", "*", "x[yz", "[]q]rs?", "/ab/**/c?d/", "**")] == ["doc_8", "bcd", ".py", "", "x", "rs", "ab", ""]
    n = 300
    rules = [("r", 2 * i, f"?[!x]/d{i}z*.*") for i in range(n)] + [("r", 2 * i + 1, f"!*d{i}z*[ab]") for i in range(n)] + [("r", -1, "?[a-z]/*")]
    files = [("r", f"en/d{i}z.{end}") for i in range(n) for end in ("a", "c")] + [("r", "en/q"), ("r", "xx/q"), ("s", "en/d1z.a")]
    table = spark.createDataFrame(rules, "repo string, ord int, pattern string")
    tree = spark.createDataFrame(files, "repo string, path string")
    got = {(r.repo, r.path): (r.ord, r.negated) for r in rule_index.last_rule(tree, table).collect()}
    want = {("r", f"en/d{i}z.{end}"): (2 * i + (end == "a"), end == "a") for i in range(n) for end in ("a", "c")}
    assert got == want | {("r", "en/q"): (-1, False), ("r", "xx/q"): (-1, False)}
    globs = rule_index.compiled_rules(table).where("literal <> ''").select("repo", "literal")
    met = rule_index._literal_parts(tree, rule_index.compiled_rules(table)).join(globs, ["repo", "literal"])
    assert met.count() <= 2 * 2 * n


def test_watched_events(spark):
    rules = spark.createDataFrame([("a", 0, "*.log"), ("a", 1, "!keep.log"), ("b", 0, "/x/")], "repo string, ord int, pattern string")
    events = list(itertools.product("ab", ["t.log", "keep.log", "x/y", ".git/config"]))
    table = spark.createDataFrame(events, "repo string, path string")
    assert {tuple(r) for r in rule_index.watched_by_rules(table, rules).collect()} == {("a", "keep.log"), ("a", "x/y"), ("b", "t.log"), ("b", "keep.log"), ("b", "x/y")}


def test_no_rules(spark):
    files = spark.createDataFrame([("r", "a")], "repo string, path string")
    rules = spark.createDataFrame([], "repo string, ord int, pattern string")
    assert [tuple(r) for r in rule_index.with_rule_match(files, rules, "hit").collect()] == [("r", "a", False)]
