"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on: ANSI arithmetic, AQE with skew-join splitting,
# UTC so that no time zone leaks into results.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints of the distributed ranking are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "moodweave", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults.

    On a cluster the session normally already exists (spark-submit); then only
    missing SQL settings are filled in, never overridden.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
            if master.startswith("local"):
                # local mode: the driver JVM is the only executor
                builder = builder.config("spark.driver.memory", "12g")
        for k, v in DEFAULT_CONF.items():
            builder = builder.config(k, v)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        for k, v in (extra or {}).items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir).  A cluster must name one that all executors share; only a local
    master, whose driver is its executor, gets a fresh folder when none is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return configured or ""
    root = sc.getCheckpointDir()
    if root:
        return root
    if not configured and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = configured or tempfile.mkdtemp(prefix="moodweave-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Within it a query's shuffle files are deleted as soon as the query ends, not when the driver next collects garbage.

    For queries whose results are written: nothing reads their shuffles again.
    """
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def joined_as_dealt(spark: SparkSession):
    """Within it a join of two sides that are both dealt by some of its keys takes them as they lie, without another shuffle."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


__all__ = ["get_session", "checkpoint_root", "scratch_path", "freed_shuffles", "joined_as_dealt", "DEFAULT_CONF"]
