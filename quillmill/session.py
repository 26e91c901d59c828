"""Session set-up and the few helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmill")
        .config("spark.sql.shuffle.partitions", shuffle_partitions or os.cpu_count() or 8)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder the cluster names.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests) a
    temporary folder is used; on a cluster a missing folder is an error. Files in the shared folder survive the loss
    of any executor.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmill-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
