"""State between the steps of driver loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder set with ``setCheckpointDir``.

    Without either a session on one machine gets a temporary folder; a cluster gets an error, since
    executors do not share a local one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def broadcast_as_measured(spark: SparkSession) -> None:
    """Broadcast by sizes that adaptive execution has measured, up to the session's threshold, not by the sizes of files.

    Columns of node tables shrink some hundred times in a file, so that a file below the threshold may hold more
    than the driver's memory.
    """
    files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(files)
    if most != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, most)
        spark.conf.set(files, "-1")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from it.

    A written table has the size of its file, where a checkpoint keeps the estimate of its plan; in loops that
    join their state with itself such estimates grow beyond all bounds. Whether a table is broadcast
    follows from what it measures in memory.
    """
    broadcast_as_measured(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
