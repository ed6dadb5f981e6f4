"""Local session for checks, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from meterlake import configure


def ensure_shared_folder(spark: SparkSession) -> None:
    """Give a local session without a checkpoint folder one of its own; a cluster must name it."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meterlake-"))


def local_session(cpus: str | None = None) -> SparkSession:
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName("meterlake")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(spark)
    return configure(spark)
