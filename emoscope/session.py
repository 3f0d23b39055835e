"""Spark session helpers.

On a cluster the session comes from the launcher; these helpers only fill in
settings that are unset, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query relies on.  AQE re-plans joins and coalesces small
# shuffle partitions at run time; skew-join splits hot join keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "emoscope", cpus: int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off, no ports)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A folder that the launcher has set on the context stays; else the setting
    ``spark.checkpoint.dir`` names it.  Only a local session may go without
    either (tests) and gets a fresh scratch folder; on a cluster that would be
    a folder no other machine sees, so it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        # the context reports a folder of its own inside the one it was given
        return current
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="emoscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    context.setCheckpointDir(current)
    return current
