"""Shared storage for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def _shared_folder(sc: SparkContext) -> str:
    """The session's checkpoint folder.

    One of our own is set only where that is unset and the session runs on one machine, as in tests; on a
    cluster it is an error, as a folder of one machine would be lost with it.
    """
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write a table of small rows to the shared folder and read it back.

    Plans over it know its real size.  A checkpoint keeps the estimate of the plan that made it, and estimates of
    joins multiply, so in a loop of joins they grow to numbers that take the planner minutes.
    """
    spark: SparkSession = df.sparkSession
    path = f"{_shared_folder(spark.sparkContext)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from the folder all executors share."""
    _shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)
