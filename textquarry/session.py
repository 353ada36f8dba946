"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Session windows of a hot path are merged in each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # State of streams lies on disk, not in the heap.
    STATE_STORE: ROCKSDB,
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and trials, with a shared folder of its own that goes when
    Python ends. On a cluster use the session it gives you, with ``spark.checkpoint.dir`` set."""
    folder = tempfile.mkdtemp(prefix="textquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textquarry")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", folder)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's setting, which
    is as before afterwards. Timers need it: Spark's default store refuses them."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, for tables and stream checkpoints.

    It lies below ``spark.checkpoint.dir``. Where that is unset, a session on this machine
    alone uses a temporary folder of it, and any other is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/textquarry/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="textquarry-"), name)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run alone below the shared one."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def clear_shared(spark: SparkSession) -> bool:
    """Remove all that operators have left below the shared folder. Results that were not
    computed yet may still read from there, so call it when a job has written its output."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/textquarry")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
