from datetime import datetime, timezone

from textquarry.session import run_folder
from textquarry.streaming import debounce
from textquarry.streaming.apply import drain
from textquarry.streaming.listings import CHANGES, Listings


def listing(spark, files):
    return spark.createDataFrame([("r", p, h) for p, h in files.items()], "repo string, path string, blob_sha string")


def rows(df):
    return sorted((r.snapshot, r.path, r.event_type) for r in df.collect())


def read_on(listings, base):
    query = listings.stream().writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    drain(query.trigger(availableNow=True).start())
    return rows(listings.spark.read.schema(CHANGES).parquet(f"{base}/out"))


STATES = [{"a": "1", "b": "1", "c": "1"}, {"a": "2", "b": "1", "d": "1"}, {"a": "2", "b": "1", "d": "1"}, {"b": None, "d": "3"}, {}]
WANT = [
    (0, "a", "created"), (0, "b", "created"), (0, "c", "created"), (1, "a", "modified"), (1, "c", "deleted"), (1, "d", "created"),
    (3, "a", "deleted"), (3, "d", "modified"), (4, "b", "deleted"), (4, "d", "deleted"),
]


def test_neighbouring_snapshots_and_replay(spark):
    base = run_folder(spark, "test-listings")
    listings = Listings(spark, f"{base}/l")
    assert listings.newest() == -1 and listings.changes().collect() == []
    assert read_on(listings, f"{base}/early") == []
    for n, state in enumerate(STATES):
        assert listings.record(listing(spark, state), datetime(2024, 1, 1, 0, n, tzinfo=timezone.utc)) == n
        if n == 1:  # a stream that stands between two snapshots
            assert read_on(listings, f"{base}/s1") == [w for w in WANT if w[0] <= 1]
    assert rows(listings.changes()) == WANT and rows(listings.changes(after=1)) == [w for w in WANT if w[0] > 1]
    assert read_on(listings, f"{base}/s1") == WANT  # goes on where it stood
    assert read_on(listings, f"{base}/s2") == WANT  # starts anew and replays
    assert read_on(listings, f"{base}/early") == WANT
    quiet = debounce.debounce_batch(listings.changes(), 90)
    assert {(r.path, r.event_type, r.events) for r in quiet.collect() if r.path in "abc"} == {("a", "modified", 2), ("a", "deleted", 1), ("b", "created", 1), ("b", "deleted", 1), ("c", "deleted", 2)}


def test_a_failed_run_is_taken_up(spark):
    base = run_folder(spark, "test-listings")
    listings = Listings(spark, f"{base}/l")
    listings.record(listing(spark, STATES[0]))
    # A part of snapshot 1 was written and read, then the run failed before it was done.
    part = spark.createDataFrame([("r", "c", "deleted", datetime(2024, 1, 1), 1)], CHANGES)
    part.write.mode("append").parquet(f"{base}/l/changes")
    assert read_on(listings, f"{base}/s")[-1] == (1, "c", "deleted")
    assert listings.newest() == 0 and listings.record(listing(spark, STATES[1])) == 1
    assert rows(listings.changes()) == [w for w in WANT if w[0] <= 1] == read_on(listings, f"{base}/s")


def test_polled_trees(spark, tmp_path):
    (tmp_path / "x.py").write_text("a")
    (tmp_path / "_sub").mkdir()
    (tmp_path / "_sub" / "y.py").write_text("b")
    listings = Listings(spark, run_folder(spark, "test-listings"))
    roots = {"t": str(tmp_path)}
    listings.poll(roots)
    (tmp_path / "x.py").write_text("longer")
    (tmp_path / "_sub" / "y.py").unlink()
    assert listings.poll(roots) == 1
    assert rows(listings.changes()) == [(0, "_sub/y.py", "created"), (0, "x.py", "created"), (1, "_sub/y.py", "deleted"), (1, "x.py", "modified")]
