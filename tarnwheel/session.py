"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(app: str = "tarnwheel", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster pass the one you have to ``prepare``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


# settings that results or balance depend on
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more shuffle after it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # stream state on local disk and in the checkpoint, not in executor heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # what one exchange with a Python worker may hold, whatever the length of texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # a partitioned write keeps so many files open before it sorts the rows of its task
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # sessions are merged within each task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the queries rely on. Called by whoever owns the session, never by a query."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    """A folder that goes away with the process."""
    return tempfile.TemporaryDirectory(prefix="tarnwheel-", ignore_cleanup_errors=True)


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for tables and stream checkpoints every executor can reach.

    It lies in the folder named by ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder of this machine. Results may be read from it
    lazily, so it is kept until ``release`` or the end of the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_scratch().name
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> int:
    """Remove all scratch folders of this process; returns how many there were.

    For the owner of the session, once nothing is read from results any more. A folder
    that cannot be reached is left.
    """
    removed = 0
    while _made:
        spark, path = _made.pop()
        for folder in (path, f"{path}-checkpoint"):
            try:
                target = spark._jvm.org.apache.hadoop.fs.Path(folder)
                files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
                removed += bool(files.delete(target, True))
            except Exception:  # the session or its JVM is gone
                continue
    return removed
