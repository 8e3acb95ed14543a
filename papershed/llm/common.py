"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unsigned_crc32(text: Column) -> Column:
    """Spark's crc32 is already an unsigned value in a long."""
    return F.crc32(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a session with a local master may lack one; it
    gets a temporary folder. Elsewhere that would scatter data over the executors' disks, so it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="papershed-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data through Spark's own file systems, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: lineage ends here, and a lost executor costs nothing.

    Checkpoints are removed once nothing refers to them if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` set, which long-lived sessions should have.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
