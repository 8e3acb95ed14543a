"""Sessions and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TITLE_CHARS = 60


def sessions(turns: DataFrame) -> DataFrame:
    """A session's title (its first user text, cut at 60 characters), turn count and text size."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    cut = F.when(F.char_length("t") > TITLE_CHARS, F.concat(F.substring("t", 1, TITLE_CHARS), F.lit("…"))).otherwise(F.col("t"))
    grouped = turns.groupBy("conv_id").agg(first.alias("t"), F.count("*").alias("n_turns"), F.sum(F.char_length("text")).alias("n_chars"))
    return grouped.select("conv_id", cut.alias("title"), "n_turns", "n_chars")


def folded(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: ``by, run, value, first, n`` (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    return (
        rows.withColumn("_new", changed)
        .withColumn("run", F.sum("_new").over(w))
        .groupBy(by, "run", value)
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
    )


def answered(calls: DataFrame, by: str, key: str, order: str, twice: int = 2) -> DataFrame:
    """Calls with whether they are answered: an identical call of a group is answered twice at most."""
    nth = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    return calls.withColumn("answered", nth <= twice)
