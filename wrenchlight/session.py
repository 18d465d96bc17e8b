"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Timestamps are rendered and truncated in the session zone, so it must be UTC.
# AQE resizes shuffles, picks broadcasts by measured size and splits skewed joins, also where
# an aggregation above then needs another shuffle: that costs less than one task with a frequent key.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


# Input behind one shuffle partition to start with.
PARTITION_BYTES = 256 << 20


def initial_partitions(cores: int, configured: int, input_bytes: int = 0) -> int | None:
    """Shuffle partitions to start with, if more than configured: by the input, and on large clusters by the cores.

    AQE merges partitions that turn out small but never splits those of an
    aggregation, so large inputs have to start with many.
    """
    wanted = max(3 * cores if cores > configured else 0, -(-input_bytes // PARTITION_BYTES))
    return wanted if wanted > configured else None


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a path, 0 if there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(found).getLength() if system.exists(found) else 0


def prepare(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    wanted = dict(RUNTIME_SETTINGS)
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
        initial = initial_partitions(spark.sparkContext.defaultParallelism, configured, input_bytes)
        if initial:
            wanted[INITIAL_PARTITIONS] = str(initial)
    for key, value in wanted.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@cache
def _own_folder() -> str:
    """One temporary folder for this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="wrenchlight-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path that every executor can reach.

    It lies below ``spark.checkpoint.dir``. Only a local session, which has no
    other machines, may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
