"""Session settings the engine is tuned for, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings that matter at scale; every one of them may be overridden by the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Few bytes may go to many date folders: tasks are merged only below this size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Folders are listed by a job; a task for each of thousands of them costs more than it lists.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(app_name: str = "teleskein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a write go when the write ends; else they stay on the
    executors' disks until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for state that outlives one job.

    It lies under ``spark.checkpoint.dir``, which every executor sees. Only where that setting
    is absent and the master is this one process is a local folder made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return f"{shared.rstrip('/')}/teleskein-{label}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"teleskein-{label}-")
