"""Session helpers: one place for Spark settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def build_session(app_name: str = "meterloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are planned for; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local master may go without the setting; it then gets a folder of
    its own, because driver and executors are one process there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="meterloom-")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/meterloom/{label}-{uuid.uuid4().hex}"


def settle(df, label: str, *partition_by: str):
    """Write a small or expensive intermediate once and read it back.

    The written table survives lost executors and gives later plans exact sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_split_layout(spark: SparkSession) -> None:
    """Keep file splits equal from job to job.

    Spark sizes splits by the cores present when a scan is planned. Row ids
    join two scans of the same files, so the number must not move when
    executors come or go.
    """
    if spark.conf.get(MIN_PARTITIONS, None) is None:
        spark.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))


def fence(df):
    """Add `_fence`, always true, for a filter that must not move below `df`.

    A filter on parsed columns would otherwise be pushed under the parse, with
    the parse copied into the filter once per use. Filters do not pass a
    non-deterministic projection.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id() >= 0)
