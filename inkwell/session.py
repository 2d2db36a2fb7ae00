"""Spark session settings shared by the jobs, the tests and the bench.

On a cluster the session is created by the platform; ``configure`` only
sets what the jobs rely on (UTC, ANSI, AQE with skew handling) and never
overrides a checkpoint folder the cluster already names.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on for correct and scalable plans.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE merges partitions by their compressed size. The default of 64 MB came
    # to 3 million narrow rows in one task, 1.5 GB once sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Broadcast is size-checked twice: the static bound is small because,
    # without CBO, a join's output is estimated as the product of its
    # inputs (a big fact side then looks smaller than a joined dimension);
    # AQE re-plans with the measured shuffle sizes under the larger bound.
    # Anything beyond stays a sort-merge join (skewed partitions split).
    "spark.sql.autoBroadcastJoinThreshold": str(2 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs expect to an existing session and
    send the package to its Python workers. A setting that the platform locks
    must already have the value; anything else is an error."""
    for key, value in JOB_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) != value:
            raise ValueError(f"{key} is locked and not {value}")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application, so that
    Python workers can import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_inkwell_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="inkwell-package-")  # the driver's own; Spark hands the file out
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "inkwell"), "zip", root, "inkwell"))
    context._inkwell_shipped = True


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "inkwell") -> SparkSession:
    """Local session for tests and the bench (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("INKWELL_DRIVER_MEM", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Only a local
    session without one gets a scratch folder; on a cluster that is an error,
    because executors would not share it."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="inkwell-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate
    tables (cuts lineage and survives executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
