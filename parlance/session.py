"""Session set-up and the shared folder that jobs may write to."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Tasks merge sessions before the shuffle, so that a hot session id sends a few rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Keeps the state of streams off the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app_name: str = "parlance", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is planned and executed inside hands at most ``rows`` rows at once to a Python worker, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files as soon as it has ended, as nothing reads them after a write."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the checkpoint folder that the cluster names.

    Only a local master without that setting (tests, a laptop) falls back to a folder of
    this machine; on a cluster the other machines could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/parlance/{label}-{uuid.uuid4().hex[:12]}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="parlance-")
