"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter for correctness (UTC for day(ts)) and for scale (AQE
# re-plans joins from runtime sizes, splits skewed partitions and coalesces
# small shuffle outputs).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "judgefuse") -> SparkSession:
    """Local session for tests and the bench; clusters pass their own conf."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", os.environ.get("JF_DRIVER_MEM", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a ``local`` master (tests, the bench) uses one below the
    warehouse; on a cluster that is an error, because a machine-local folder
    would not survive a lost executor.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure that checkpoints go to the shared folder; returns their folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()
