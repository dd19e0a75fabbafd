"""Session helpers: build a session for local runs / tests, and resolve the
checkpoint directory the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "loadshape", driver_memory: str | None = None) -> SparkSession:
    """Session for local runs and tests. In local mode every task runs in the
    driver JVM, so its heap is the memory of all task threads: size it with
    ``driver_memory`` (or ``LOADSHAPE_DRIVER_MEMORY``); it only applies when
    this call starts the JVM. On a cluster the submit settings rule."""
    master = master or os.environ.get("SPARK_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app)
    memory = driver_memory or os.environ.get("LOADSHAPE_DRIVER_MEMORY")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # delete checkpoint files once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint dir of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only in local mode (tests) with nothing configured is a fresh
    folder under the system temp dir taken; on a cluster an unset value is an
    error, as a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running iterative operators")
    folder = tempfile.mkdtemp(prefix="loadshape-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


MB = 1 << 20


def scale_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 * MB,
                   first_reduction: int = 8) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of meter Parquet.

    * scan splits of ``target_partition_bytes`` (one task per split);
    * initial shuffle partitions sized on the first shuffle, which carries the
      household-day partials (about ``input / first_reduction``: 24 hourly
      readings become one row per price part, wider rows), so each reducer
      gets about one target partition -- at least 2 waves of the cluster's
      cores, at most 100k; AQE then coalesces small ones and splits skewed
      ones using the same advisory size.
    """
    shuffle_bytes = max(input_bytes // max(first_reduction, 1), 1)
    partitions = max(2 * total_cores, min(100_000, -(-shuffle_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int, total_cores: int, **kw) -> dict[str, str]:
    """Set :func:`scale_settings` on a running session (all are SQL confs)."""
    conf = scale_settings(input_bytes, total_cores, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def materialize(df):
    """Write ``df`` once to the session's checkpoint dir and read it back
    (reliable checkpoint: survives executor loss and cuts lineage; never a
    local checkpoint). Used for intermediates that several later steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
