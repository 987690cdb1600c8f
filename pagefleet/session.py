"""SparkSession construction and the shared scratch/checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours relies on. They are session-level SQL confs,
# so they are applied to an existing session too (getOrCreate reuses it).
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes coalesced partitions by bytes; small-but-CPU-heavy stages
    # (variant validation, regex text work) keep more than one task. No
    # effect once shuffles are large.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Later map entries win when candidate keys are overridden.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session comes from the launcher; only the SQL confs
    above are set on it. ``spark.checkpoint.dir`` is left alone when the
    cluster names one; a local default is used only when it is unset.
    """
    active = SparkSession.getActiveSession()
    if active is None:
        from pyspark import SparkConf

        builder = SparkSession.builder.appName("pagefleet")
        # Under spark-submit the master comes from the launcher; only a bare
        # local process (tests, benches) falls back to local mode.
        if master:
            builder = builder.master(master)
        elif not SparkConf().get("spark.master", None):
            builder = builder.master("local[8]")
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "16g")
            # Checkpoint files of unreferenced DataFrames are removed.
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        )
        active = builder.getOrCreate()
        active.sparkContext.setLogLevel("ERROR")
    configure(active)
    if shuffle_partitions:
        active.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return active


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session-level settings every operator relies on to any
    session (also one handed in by a caller) and make sure a checkpoint
    folder is known."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ensure_checkpoint_dir(spark)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    # Unset (tests, local runs): a local folder is acceptable only here.
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pagefleet-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = _ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """Spread an input that arrives in fewer partitions than the cluster has
    cores (e.g. one Parquet row group) before CPU-heavy row work.

    Planning-only check (no job): a large input already has many splits and
    is returned untouched, so this never adds a shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def checkpointed(df):
    """Reliable checkpoint (eager) into the shared checkpoint folder; the
    folder is taken from ``spark.checkpoint.dir`` and only set locally when
    the session has none (tests)."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
