"""Copies of the tables that meet by job, bucketed by job_id, so that jobs, invoices, crews and visits are joined and summed per job without a shuffle.

Worth its one shuffle where KPIs are computed many times from the same load. A bucket is a file and is read by one task, so a table in which one
job holds more than a bucket's share of the rows is not copied; it is read as stored, and its joins are shuffled, where AQE can split the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wrenchlight.operators.filters import scanned_bytes
from wrenchlight.operators.joins import hot_keys
from wrenchlight.session import PARTITION_BYTES
from wrenchlight.sources.tables import Tables

KEY = "job_id"
BY_JOB = ("jobs", "invoices", "job_employees", "job_appointments")


def _name(root: str, table: str) -> str:
    return f"by_job_{uuid.uuid5(uuid.NAMESPACE_URL, root).hex}_{table}"


def buckets_for(tables: Tables) -> int:
    """Buckets of about ``PARTITION_BYTES`` of the largest table, one per core at least."""
    largest = max(scanned_bytes(tables[name]) for name in BY_JOB)
    return max(tables.spark.sparkContext.defaultParallelism, -(-largest // PARTITION_BYTES))


def write_by_job(tables: Tables, root: str, buckets: int | None = None) -> Tables:
    """Write the bucketed copies below ``root`` and return the tables with them in place of the stored ones."""
    buckets = buckets or buckets_for(tables)
    copied = []
    for name in BY_JOB:
        rows = tables[name]
        if hot_keys(rows, KEY, 1 / buckets).isEmpty():
            # The shuffle deals rows out as buckets do, so each bucket becomes one file.
            dealt = rows.repartition(buckets, KEY)
            dealt.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{root}/{name}").saveAsTable(_name(root, name))
            copied.append(name)
    frames = {name: tables.spark.table(_name(root, name)) for name in copied}
    return Tables(tables.spark, lambda name: frames.get(name, tables[name]))


def read_by_job(spark: SparkSession, root: str, tables: Tables, buckets: int) -> Tables:
    """The copies that another session wrote with so many buckets, entered in this session's catalog."""

    def load(name: str) -> DataFrame:
        if name not in BY_JOB or not tables.exists(name):
            return tables[name]
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return tables[name]
        if not spark.catalog.tableExists(_name(root, name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[name].schema)
            spark.sql(f"CREATE TABLE {_name(root, name)} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{root}/{name}'")
        return spark.table(_name(root, name))

    return Tables(spark, load)


def forget(spark: SparkSession, root: str) -> None:
    """Take the copies out of the session's catalog; their files stay."""
    for name in BY_JOB:
        spark.sql(f"DROP TABLE IF EXISTS {_name(root, name)}")
