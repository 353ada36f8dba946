import os
import random
import time

import pytest
from test_streaming import START, events, plain, run, shown, stream

from textquarry.streaming import timers


def exact(rows, gap):
    """Quiet periods with events exactly the gap apart in two."""
    return plain(rows, gap - 1e-6)


def write(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_joined_periods():
    p = [(0, 1, 5, "a", 1), (3, 3, 6, "b", 1), (2, 2, 7, "c", 2), (9, 9, 1, "d", 1), (11, 12, 2, "e", 1)]
    assert timers.joined_periods(p, 2) == [(0, 3, 6, "b", 4), (9, 9, 1, "d", 1), (11, 12, 2, "e", 1)]
    assert timers.joined_periods([(0, 5, 1, "x", 1), (1, 2, 9, "y", 1)], 1) == [(0, 5, 1, "x", 2)]
    assert timers.joined_periods([], 3) == []


@pytest.mark.parametrize("step", [60, 500])
def test_event_time_over_restarts(spark, tmp_path, step):
    """Events out of order, restarts after each part: what comes out is the same."""
    rng = random.Random(6)
    kinds = ["created", "modified", "deleted"]
    rows = [(round(i * 0.5 + rng.choice([0, 0.5, 1, 1.5, 6]), 1), f"p{rng.randrange(4)}", rng.choice(kinds)) for i in range(300)]
    rows += [(500 + 2.0 * i, "touching", "modified") for i in range(5)] + [(600 + 1.9 * i, "chain", "created") for i in range(5)]
    source = tmp_path / "events"
    os.makedirs(source)
    every = events(spark, [*rows, (100_000, "end", "modified")])
    df = timers.debounce_timers(stream(spark, source, rows), watermark="30 seconds")
    for at in range(0, len(rows), step):
        write(every.where(f"event_id >= {at} AND event_id < {min(at + step, len(rows))}"), source)
        run(df, tmp_path)
    held = spark.read.schema(df.schema).parquet(f"{tmp_path}/out").count()
    write(every.where("path = 'end'"), source)
    run(df, tmp_path)
    got = spark.read.schema(df.schema).parquet(f"{tmp_path}/out").where("path <> 'end'")
    assert held < got.count()  # some were still pending and outlived the restart
    assert shown(got.collect()) == exact(rows, 2.0)


def test_a_path_is_reported_while_others_go_on(spark, tmp_path):
    source = tmp_path / "events"
    rows = [(0, "a", "created"), (1, "a", "deleted"), (1, "b", "modified"), (60, "c", "modified"), (61, "c", "modified")]
    write(events(spark, rows), source)
    df = timers.debounce_timers(stream(spark, source, rows), watermark="5 seconds")
    run(df, tmp_path)
    got = shown(spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "deleted", 2, 0, 1), ("b", "modified", 1, 1, 1)]


def test_processing_time_fires_by_the_clock(spark, tmp_path):
    source = tmp_path / "events"
    os.makedirs(source)
    rows = [(0, "a", "created"), (500, "a", "modified"), (2, "b", "deleted")]
    every = events(spark, rows)
    df = timers.debounce_timers(stream(spark, source, rows), 1.0, time="processing")
    query = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        write(every, source)
        out, until = spark.createDataFrame([], df.schema), time.time() + 90
        while out.count() < 2 and time.time() < until:
            time.sleep(0.5)
            if query.exception():
                raise query.exception()
            if any(f.startswith("part-") for f in os.listdir(tmp_path / "out")) if (tmp_path / "out").exists() else False:
                out = spark.read.schema(df.schema).parquet(f"{tmp_path}/out")
    finally:
        query.stop()
    # However far apart their own times are, what arrives together is one change.
    assert {(r.path, r.event_type, r.events) for r in out.collect()} == {("a", "modified", 2), ("b", "deleted", 1)}


def test_hot_path_is_folded_before_the_shuffle(spark):
    rows = [(0.001 * i, "hot", "modified") for i in range(4000)] + [(100, "hot", "deleted")]
    folded = timers.folded(events(spark, rows).coalesce(1), 2_000_000).collect()
    assert [(r.events, r.event_type) for r in folded] == [(4000, "modified"), (1, "deleted")]
    assert START.timestamp() * 1e6 == folded[0].first_us


def test_unknown_time(spark):
    with pytest.raises(ValueError, match="unknown time"):
        timers.debounce_timers(events(spark, []), time="wall")


def test_query_in_a_session_with_the_default_state_store(spark, tmp_path):
    from textquarry import session
    from textquarry.plans.vector_queries import debounce_timers

    hours = [0, 1, 3, 5, 5.5]  # two hours apart are two periods
    rows = [(i, f"2024-01-01 {int(h):02}:{int(h % 1 * 60):02}:00", 7, "click", 0.0, "{}") for i, h in enumerate(hours)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    made.selectExpr("event_id", "CAST(ts AS timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(session.STATE_STORE)
    default = before.replace("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider")
    spark.conf.set(session.STATE_STORE, default)
    try:
        got = debounce_timers(spark, str(tmp_path)).collect()
        assert spark.conf.get(session.STATE_STORE) == default
    finally:
        spark.conf.set(session.STATE_STORE, before)
    periods = sorted((r.path, r.events, r.last_us - r.first_us) for r in got)
    assert periods == [("f7.py", 1, 0), ("f7.py", 2, 1_800_000_000), ("f7.py", 2, 3_600_000_000)]
