"""Spark session with the settings the plans of this package expect, and scratch space that all executors see."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", app: str = "millrace", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments (dots as double underscores) override them."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    spark = SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for scratch: the cluster's spark.checkpoint.dir. Where that is unset, a
    temporary one, but only if all runs in one process; a cluster without it raises RuntimeError."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: it outlives lost executors and has no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that only Spark may be able to reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that no table refers to any more; else they stay until the driver
    happens to collect its garbage."""
    for _ in range(2):  # the first round lets go of what refers to the rest
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
