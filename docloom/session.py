"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

#: Scratch folder of each local application that has no shared folder set.
_SCRATCH: dict[str, str] = {}


def build_session(app_name: str = "docloom", cores: int | None = None) -> SparkSession:
    """Session for tests, benches and local runs.

    Where a submitter has named a master, its settings stand; without one, the run is local
    on ``cores`` threads with as many shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if SparkConf().get("spark.master", None) is None:
        cores = cores or os.cpu_count() or 8
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        )
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A local master has one machine only, so an unset value falls back to a fresh
    scratch folder there; anywhere else an unset value is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return _SCRATCH[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives lost executors and truncates iterative plans."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)
