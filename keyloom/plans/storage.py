"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A temporary folder stands in only where none is set and driver and executors
    are one process; a cluster without the setting raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def stable(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Removes what ``stable`` kept of the frame; nothing that is still to be read may need it."""
    kept = df._jdf.queryExecution().analyzed()
    if kept.getClass().getSimpleName() == "LogicalRDD":
        file = kept.rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())
