"""Spark session settings the pipeline relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings every session running these operators needs: UTC calendar math,
#: AQE (coalescing, skew-join splitting, runtime broadcast), no web UI.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "spendpace", extra: dict | None = None, facts: list[str] | None = None) -> SparkSession:
    """A session with the settings above. ``facts``: paths of the run's fact
    tables, whose size sets the partitioning (``scale_settings``) once, here;
    no query changes it later."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if facts:
        apply_scale_settings(spark, input_bytes(spark, facts))
    return spark


#: Target bytes per shuffle / scan partition at scale: big enough to keep
#: task overhead small, small enough to sort and aggregate in memory.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


#: Cap on shuffle partitions: map-output tracking on the driver grows with
#: map tasks x reduce partitions.
MAX_SHUFFLE_PARTITIONS = 20000


def scale_settings(input_bytes: int, target: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of fact data.

    Scans split at ``target`` bytes. The shuffles of this pipeline carry
    map-side partially aggregated rows (daily and hourly grain), far fewer
    bytes than the scan, so the initial shuffle partition count is one per
    16 x ``target`` of input, between 200 and MAX_SHUFFLE_PARTITIONS; AQE
    coalesces them to ~``target / 2`` after each stage and splits skewed
    join partitions (> 4x the median and > 2 x ``target``).
    """
    n = min(MAX_SHUFFLE_PARTITIONS, max(200, -(-input_bytes // (16 * target))))
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target),
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int) -> dict[str, str]:
    """Apply ``scale_settings`` for keys the deployment has not set; returns
    what was applied. (At 100 TB: 409,600 scan tasks of 256 MB and 20,000
    initial shuffle partitions, coalesced by AQE.)"""
    applied = {}
    defaults = {"spark.sql.files.maxPartitionBytes": "134217728", "spark.sql.shuffle.partitions": "200"}
    wanted = scale_settings(input_bytes)
    shuffle_keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    if spark.conf.get(shuffle_keys[0], None) not in (None, defaults[shuffle_keys[0]]):
        # a chosen shuffle partition count also fixes AQE's initial count
        for k in shuffle_keys:
            wanted.pop(k)
    for k, v in wanted.items():
        current = spark.conf.get(k, None)
        if current is None or current == defaults.get(k):
            spark.conf.set(k, v)
            applied[k] = v
    return applied


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total bytes under ``paths`` from the file system's metadata (no data
    is read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return int(total)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    On a cluster it is set by the deployment and only read here; a cluster
    without it raises. In local mode a scratch folder stands in.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="spendpace-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def state_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df):
    """Cut lineage at a stage boundary by writing the stage as a parquet
    table under the shared ``spark.checkpoint.dir`` and reading it back.

    The plan is computed once (an RDD checkpoint computes it twice), the
    files survive executor loss, and the read-back scan carries real size
    statistics, so later joins against small stage tables are planned as
    broadcasts by Spark's own size threshold and large ones stay shuffled.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "stage-" + uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    return spark.read.schema(df.schema).parquet(path)
