"""Inbox, queue and source operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INBOX_LIMIT = 500
RECENT_DAYS = 28


def state() -> Column:
    """The derived decision state, the strongest decision first."""
    return (
        F.when(F.col("queued_s").isNotNull(), "queued")
        .when(F.col("dismissed_s").isNotNull(), "dismissed")
        .when(F.col("opened_s").isNotNull(), "opened")
        .when(F.col("kept_s").isNotNull(), "kept")
        .otherwise("undecided")
    )


def inbox(items: DataFrame, limit: int = INBOX_LIMIT) -> DataFrame:
    """Undecided items, newest first, ties by id: a top-k, not a full sort."""
    return items.filter(state() == "undecided").orderBy(F.desc_nulls_last("published_s"), "id").limit(limit)


def queue(items: DataFrame) -> DataFrame:
    """Queued items with their section and their order in it."""
    queued = items.filter(state() == "queued").withColumn("section", F.when(F.col("opened_s").isNotNull(), "continuing").otherwise("up_next"))
    return ranked(queued, ["source_id", "section"], ["queue_position"], "id", "nth")


def ranked(rows: DataFrame, by: list[str], coarse: list[str], fine: str, name: str) -> DataFrame:
    """Rows with their place (from 1) in their group by the coarse columns, then the fine one.

    Rows are numbered within equal coarse columns only; the counts of those before are added. So no task sorts a whole group.
    """
    before = Window.partitionBy(*by).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*by, *coarse).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*by, *coarse).orderBy(fine))
    left = rows.withColumn("_nth", nth).alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, *coarse)]
    return left.join(bases.alias("r"), same).select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_nth") + F.col("_base")).cast("int").alias(name))


def source_health(sources: DataFrame, items: DataFrame, now_s: int) -> DataFrame:
    """Every source with its item counts and weekly rate; sources without items have zeros.

    Items are counted per source before the join, so the join moves one row a source.
    """
    counts = items.groupBy("source_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("kept_s").isNotNull()).alias("n_materials"),
        F.count_if(F.col("published_s") >= now_s - RECENT_DAYS * 86400).alias("n_recent"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(counts, "source_id", "left").select(
        "source_id", zero("n_items"), zero("n_materials"), zero("n_recent"),
        (F.floor(F.coalesce("n_recent", F.lit(0)) / 4 * 10 + 0.5) / 10).alias("weekly_rate"),
    )


def due(sources: DataFrame, now_s: int) -> DataFrame:
    """Sources that aren't paused and were never synced, or not for their interval."""
    waited = (F.lit(now_s) - F.col("last_sync_s")) >= F.col("interval_minutes") * 60
    return sources.filter(F.col("paused_s").isNull() & (F.col("last_sync_s").isNull() | waited))


def next_positions(items: DataFrame) -> DataFrame:
    """The position that an item appended to a source's queue would get."""
    return items.groupBy("source_id").agg((F.coalesce(F.max("queue_position"), F.lit(-1)) + 1).alias("next_position"))


def upsert(stored: DataFrame, batch: DataFrame, key: list[str], refreshed: list[str], order: str) -> DataFrame:
    """Stored rows with those of the batch merged in by key.

    The last of a key's rows in the batch (by ``order``) wins. Columns in ``refreshed`` come from
    the batch; all others keep what is stored, so decisions survive a sync.
    """
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    new = batch.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth", order).alias("n")
    old = stored.alias("o")
    fresh = F.col(f"n.{key[0]}").isNotNull()
    columns = []
    for c in stored.columns:
        if c in refreshed:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
    return old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer").select(*columns)


def moved(items: DataFrame, chosen: Column, before_position: int) -> DataFrame:
    """Queue positions after the chosen items were put before a position, their order kept, per source."""
    group = F.when(chosen, 1).when(F.col("queue_position") < before_position, 0).otherwise(2)
    placed = ranked(items.withColumn("_group", group), ["source_id"], ["_group", "queue_position"], "id", "new_position")
    return placed.withColumn("new_position", F.col("new_position") - 1).drop("_group")
