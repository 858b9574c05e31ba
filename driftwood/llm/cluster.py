"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a place: the one in spark.checkpoint.dir.

    Where that is unset a temporary folder is used, in local mode only; a cluster has to
    name one, as a machine's own folder is out of the other executors' sight.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="driftwood-")
        context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; survives lost executors.

    Shuffle files behind it are of no more use, but executors keep them until the driver
    happens to collect its garbage, so operators in many steps would fill their disks.
    The driver is asked to collect it here.
    """
    shared_folder(df.sparkSession)
    held = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()
    return held
