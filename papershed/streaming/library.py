"""Structured Streaming forms of the event log, of debouncing and of the sync upsert.

Each takes a streaming DataFrame and returns one; ``drained`` runs such a stream over what is there
and returns the result as a batch DataFrame, from a sink and checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papershed.operators.store import save
from papershed.sources.folders import new_folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files. The table may be one file or a folder of files."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return files.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_counts(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts of each kind by week from Monday; a week comes out when the watermark has passed it."""
    weeks = log.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "event_type")
    return weeks.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("week"), "event_type", "n", "value")


def bursts(log: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """The last value of each burst of a user's events: debouncing by a session window."""
    return (
        log.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("last_event"))
        .select("user_id", F.col("w.start").alias("start"), "n", "last_event")
    )


def first_seen(log: DataFrame) -> DataFrame:
    """Append-only log without repeats of (user, kind): the first of each sticks, however late; state is one row for each pair."""
    return log.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that the stream appends until its input is used up."""
    folder = new_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def upsert_batches(stream: DataFrame, path: str, key: list[str]) -> None:
    """Saves each micro-batch into the table at ``path`` by its key; only buckets that a batch touches are written, each batch a version. A batch that is run again gives the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        save(batch.withColumn("saved_at", F.lit(number)), path, key)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
