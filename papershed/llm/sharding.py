"""Sharding through fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes are summed for each slot, which
leaves at most ``N_SLOTS`` rows however large the table is, and a slot-to-shard map with a
version is made from those sums. Moving load means editing that map: no record is hashed
anew, and only the slots whose entry changed travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SLOTS = 8192


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """A slot from 0 to n_slots - 1; a null key has a slot as well."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, n_rows`` of records with ``virtual_slot, size``."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def _filled(slots: Column, loads: Column) -> Column:
    """Deals slots, largest first, each to the shard with the least load so far."""

    def deal(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1
        return F.struct(
            F.transform(acc["loads"], lambda load, i: F.when(i == to, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.array_append(acc["shards"], to.cast("int")).alias("shards"),
        )

    zero = F.struct(loads.alias("loads"), F.lit([]).cast("array<int>").alias("shards"))
    return F.aggregate(slots, zero, deal, lambda acc: acc["shards"])


def make_map(slots: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """``virtual_slot, shard, version``: the first map, near equal in bytes.

    ``slots`` is what ``slot_bytes`` returns. Ties go to the smaller slot and shard number.
    """
    ordered = slots.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes"))).alias("slots")
    )
    zeros = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return ordered.select(
        F.explode(F.arrays_zip(F.col("slots.virtual_slot").alias("virtual_slot"), _filled(F.col("slots"), zeros).alias("shard"))).alias("e")
    ).select("e.virtual_slot", "e.shard", F.lit(version).alias("version"))


def grow_map(current: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard ``n_shards`` added: slots move into the new shard alone.

    Each old shard hands over its smallest slots as long as their bytes, summed from the
    smallest, fit into its share of the new shard's load.
    """
    sized = current.join(F.broadcast(slots.select("virtual_slot", "bytes")), "virtual_slot")
    by_shard = Window.partitionBy("shard")
    smallest = by_shard.orderBy("bytes", "virtual_slot")
    gives = F.sum("bytes").over(smallest) <= F.sum("bytes").over(by_shard) / (n_shards + 1)
    return sized.select(
        "virtual_slot",
        F.when(gives, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        (F.col("version") + 1).alias("version"),
    )


def write_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds a version to the stored maps and returns it as read back; old versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)
    return read_map(slot_map.sparkSession, path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The stored map of a version, the newest if none is named."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    wanted = F.lit(version) if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == wanted)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    ``records`` needs ``virtual_slot`` and the columns doc_id, text_crc32 for a fixed order.
    A place is the number of records in earlier virtual slots of the shard, plus the place in
    its own virtual slot, so no task ever holds a whole shard. The map and the counts have a
    row for each virtual slot, N_SLOTS at most, and are broadcast.
    """
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.join(F.broadcast(counts), "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (
        records.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), "virtual_slot")
        .withColumn("slot", (F.col("base") + F.col("place")).cast("long"))
        .drop("base", "place")
    )
