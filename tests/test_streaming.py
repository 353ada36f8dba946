import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from textquarry.operators import search
from textquarry.plans import index
from textquarry.sources import tree
from textquarry.sources.store import Store
from textquarry.streaming import apply, debounce

SCHEMA = "event_id long, ts timestamp, repo string, path string, event_type string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, rows):
    return spark.createDataFrame(
        [(i, START + timedelta(seconds=s), "r", p, k) for i, (s, p, k) in enumerate(rows)], SCHEMA
    )


def plain(rows, gap):
    """Quiet periods in plain Python: (path, last type, events, first, last)."""
    out, by_path = [], {}
    for i, (s, p, k) in enumerate(rows):
        by_path.setdefault(p, []).append((s, i, k))
    for p, es in by_path.items():
        current = []
        for e in sorted(es):
            if current and round(e[0] - current[-1][0], 6) > gap:
                out.append((p, current[-1][2], len(current), current[0][0], current[-1][0]))
                current = []
            current.append(e)
        out.append((p, current[-1][2], len(current), current[0][0], current[-1][0]))
    return sorted(out)


def shown(rows):
    t0 = START.timestamp()
    return sorted(
        (r.path, r.event_type, r.events, round(r.first_ts.timestamp() - t0, 6), round(r.last_ts.timestamp() - t0, 6))
        for r in rows
    )


def test_burst_is_one_change(spark):
    rows = [(0.1 * i, "a.py", "modified") for i in range(5)]
    assert shown(debounce.debounce_batch(events(spark, rows)).collect()) == plain(rows, 2.0)


def test_touching_gap_joins_and_last_type_wins(spark):
    rows = [(0, "a", "created"), (1.9, "a", "modified"), (3.9, "a", "deleted"), (6.0, "a", "modified")]
    got = shown(debounce.debounce_batch(events(spark, rows)).collect())
    assert [g[1:3] for g in got] == [("deleted", 3), ("modified", 1)] and got == plain(rows, 2.0)


@pytest.mark.parametrize("bucket", [None, 2.0, 6.0, 50.0])
def test_batch_debounce_with_a_hot_path(spark, bucket):
    rng = random.Random(3)
    kinds = ["created", "modified", "deleted"]
    rows = [
        (round(rng.uniform(0, 400), 1), "hot" if rng.random() < 0.5 else f"p{rng.randrange(5)}", rng.choice(kinds))
        for _ in range(1500)
    ]
    rows += [(1000 + i * 1.5, "chain", "modified") for i in range(60)]
    got = debounce.debounce_batch(events(spark, rows), bucket_seconds=bucket).collect()
    assert shown(got) == plain(rows, 2.0)


def stream(spark, folder, rows, schema=SCHEMA):
    return spark.readStream.schema(schema).parquet(str(folder))


def run(df, base):
    apply.drain(
        df.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True)
        .start()
    )


def test_replayed_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (round(i * 0.7 + rng.random() * 3, 1), f"p{rng.randrange(4)}", rng.choice(["created", "modified", "deleted"]))
        for i in range(400)
    ]
    source, step = tmp_path / "events", 100
    os.makedirs(source)
    df = debounce.debounce_stream(stream(spark, source, rows), watermark="30 seconds")
    every = events(spark, rows + [(100_000, "end", "modified")])
    for at in range(0, len(rows), step):  # several micro-batches, over restarts of the query
        every.where(f"event_id >= {at} AND event_id < {at + step}").coalesce(1).write.mode("append").parquet(str(source))
        run(df, tmp_path)
    every.where("path = 'end'").coalesce(1).write.mode("append").parquet(str(source))
    run(df, tmp_path)
    got = spark.read.schema(df.schema).parquet(f"{tmp_path}/out").where("path <> 'end'")
    assert shown(got.collect()) == plain(rows, 2.0)


def test_filters(spark):
    rows = [
        (0, "src/a.py", "modified"), (0, "node_modules/x.js", "modified"), (0, "src/b.pyc", "modified"),
        (0, "src/b.pyc", "deleted"), (0, ".git/index", "deleted"), (0, "docs/c.md", "moved"), (0, "docs/d.md", "created"),
    ]
    df = events(spark, rows)
    kept = debounce.kept_events(df, gitignore=["docs/"]).collect()
    assert sorted((r.path, r.event_type) for r in kept) == [("src/a.py", "modified"), ("src/b.pyc", "deleted")]
    options = spark.createDataFrame([("r", False), ("q", True)], "repo string, watch boolean")
    assert debounce.watched(df, options).count() == 0


def test_options_and_patterns_by_repo(spark):
    df = spark.createDataFrame(
        [(i, START, r, p, "modified") for i, (r, p) in enumerate(
            [("a", "x.md"), ("a", "y.md"), ("b", "x.md"), ("c", "x.md"), ("a", "z.py"), ("b", "target/z.py"), ("a", "target/k.py")]
        )],
        SCHEMA,
    )
    options = spark.createDataFrame(
        [("a", True, True), ("b", True, False), ("c", False, True)], "repo string, watch boolean, respect_gitignore boolean"
    )
    schema = "repo string, ord int, pattern string"
    git = spark.createDataFrame([("a", 0, "*.md"), ("b", 0, "*.md")], schema)
    include = spark.createDataFrame([("a", 0, "y.md"), ("a", 1, "target/k.py")], schema)
    got = debounce.kept_by_repo(df, options, git, include).collect()
    assert {(r.repo, r.path) for r in got} == {("a", "y.md"), ("a", "z.py"), ("b", "x.md"), ("a", "target/k.py")}


def test_stream_of_changes_keeps_an_index_current(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "a.py").write_text("def alpha():\n    pass\n")
    (repo / "pkg" / "b.py").write_text("def beta():\n    pass\n")

    def contents(keys):
        listing = tree.list_tree(spark, {"r": str(repo)}).join(keys, ["repo", "path"], "left_semi")
        read = tree.read_tree(listing)
        return read.selectExpr("repo", "path", "make_valid_utf8(cast(content as string)) AS text")

    store = Store(spark, str(tmp_path / "index"))
    every = tree.list_tree(spark, {"r": str(repo)}).select("repo", "path")
    index.index_repositories(store, contents(every))
    (repo / "a.py").write_text("def gamma():\n    pass\n")
    (repo / "pkg" / "b.py").unlink()
    (repo / "new.py").write_text("def delta():\n    pass\n")
    rows = [
        (0, "a.py", "modified"), (0.5, "a.py", "modified"), (1, "pkg/b.py", "deleted"), (1, "new.py", "created"),
        (100, "end.py", "deleted"), (100_000, "end.py", "deleted"),
    ]
    source = tmp_path / "events"
    events(spark, rows).coalesce(1).write.parquet(str(source))
    quiet = debounce.debounce_stream(debounce.kept_events(stream(spark, source, rows)))
    for _ in range(2):  # a restarted stream has nothing left to do
        query = apply.apply_stream(
            quiet, store, contents, checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}
        )
        apply.drain(query)
        files = {r.path: r.text for r in store.files().collect()}
        assert files == {"a.py": "def gamma():\n    pass\n", "new.py": "def delta():\n    pass\n"}
        hit = search.search_postings(store.live("postings"), store.files(), "gamma").collect()
        assert [(r.path, r.line) for r in hit] == [("a.py", 1)]


def test_other_runs_may_come_between_micro_batches(spark, tmp_path):
    """A run between two micro-batches of a stream keeps its rows, and so do both batches."""
    store = Store(spark, str(tmp_path / "index"))
    source, none = tmp_path / "events", spark.createDataFrame([], "repo string, path string")

    def contents(keys):
        return keys.selectExpr("repo", "path", "concat('text of ', path) AS text")

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        quiet = stream(spark, source, rows).selectExpr("repo", "path", "event_type", "ts AS last_ts")
        apply.drain(apply.apply_stream(quiet, store, contents, checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}))

    run([(0, "first.md", "created")])
    manual = spark.createDataFrame([("r", "manual.md", "by hand")], "repo string, path string, text string")
    index.apply_changes(store, manual, none)
    run([(10, "second.md", "created")])
    assert {r.path for r in store.files().collect()} == {"first.md", "manual.md", "second.md"}
    index.apply_changes(store, manual.limit(0), none.union(spark.createDataFrame([("r", "first.md")], none.schema)))
    run([(20, "third.md", "created")])
    assert {r.path for r in store.files().collect()} == {"manual.md", "second.md", "third.md"}


def test_late_events_are_written_down(spark, tmp_path):
    source, out = tmp_path / "events", str(tmp_path / "out")

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        query = debounce.record_late(stream(spark, source, rows), out, str(tmp_path / "cp"), trigger={"availableNow": True})
        apply.drain(query)

    run([(0, "a", "modified"), (500, "b", "modified")])
    run([(10, "late", "modified"), (450, "in time", "modified"), (900, "c", "modified")])
    run([(500, "late too", "deleted"), (850, "in time", "modified")])
    late = spark.read.parquet(f"{out}/late")
    assert {r.path for r in late.collect()} == {"late", "late too"} and late.count() == 2


def test_a_failing_stream_is_raised(spark, tmp_path):
    source = tmp_path / "events"
    events(spark, [(0, "a", "modified"), (9999, "b", "modified")]).write.parquet(str(source))
    quiet = debounce.debounce_stream(stream(spark, source, []))

    def broken(keys):
        raise RuntimeError("no contents")

    store = Store(spark, str(tmp_path / "index"))
    query = apply.apply_stream(
        quiet, store, broken, checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}
    )
    with pytest.raises(Exception, match="no contents"):
        apply.drain(query)
