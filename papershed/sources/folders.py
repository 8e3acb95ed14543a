"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session with a local master may lack it and gets a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="papershed-")
    return known.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *by: str, times: int = 4) -> DataFrame:
    """The rows dealt by the columns ``by`` to as many tasks as a shuffle has, ``times`` the cores at least, also if they are few bytes: what follows is work, not reading."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), times * spark.sparkContext.defaultParallelism), *by)


def kept(rows: DataFrame, *by: str, wide: bool = False) -> DataFrame:
    """The rows dealt by the columns ``by`` (``wide``: as ``spread`` deals) and checkpointed in the shared folder: all that reads them shares one computation and one shuffle."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return (rows if not by else spread(rows, *by) if wide else rows.repartition(*by)).checkpoint()
