"""Spark session helpers.

The library never creates a session on its own inside an operator; these
helpers are for scripts, tests and the bench.  They pin the settings the
operators rely on: UTC session time zone (timestamps compare equal with
other engines), adaptive execution on (runtime coalescing, skew-join
splitting, broadcast conversion from measured sizes), Arrow transfer on.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tablewright", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_settings(input_bytes: int, cores: int, target_partition_bytes: int = 128 << 20) -> dict:
    """Settings sized for a large input (e.g. 100 TB on a 1000-executor cluster).

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input, between 2 and 50 per core (map tasks x reducers is the number of
    shuffle blocks, so the count is capped); adaptive execution coalesces
    small ones and splits skewed ones at runtime; scans read
    ``target_partition_bytes`` splits.  Apply with
    ``get_spark(extra=cluster_settings(...))``.
    """
    parts = min(max(2 * cores, -(-input_bytes // target_partition_bytes)), 50 * cores)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session.

    On a cluster the folder must be a shared one named by
    ``spark.checkpoint.dir``; it is read from the session.  Only a local
    session (tests, a laptop) without that setting gets a fresh folder of
    its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tw-checkpoint-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; ordered operators need a shared "
        "checkpoint folder on a cluster")


def scratch_dir(prefix: str = "tw-run-") -> str:
    """A new local scratch folder for tests (never used by operators)."""
    return tempfile.mkdtemp(prefix=prefix, dir=os.environ.get("TMPDIR", "/tmp"))
