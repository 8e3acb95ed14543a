"""Ranks by a distributed radix sort from the least significant digit up.

Rows lie in blocks of a bounded size. A pass counts each block's digits, turns the counts into the
first place of every (digit, block) by prefix sums, and sends each row to that place plus the
number of rows with its digit before it in its block: a stable counting sort. After the pass over the most significant
digit a row's place is its rank. No pass gathers more than a block's rows of one digit, and each
pass is written to reliable storage, so that a lost executor costs one pass at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.llm.common import stored

#: Bits of a digit and rows of a block: a pass counts at most 2^BITS digits a block.
BITS, BLOCK = 11, 1 << 15


def _digits(keys: list[str]) -> list[Column]:
    """The digits of a composite key, the least significant first; each key is read as unsigned 64 bits."""
    return [
        F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        for key in reversed(keys)
        for shift in range(0, 64, BITS)
    ]


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2... in ascending order of the long columns ``keys``, the first the most significant.

    Keys are compared as unsigned numbers and must not be null; ``place``, ``block`` and ``digit`` are no names of other columns. Rows with
    equal keys come in the order in which they lie. Digits that are the same in all rows need no pass.
    """
    now = rows.withColumn("place", F.monotonically_increasing_id())
    now = stored(now.withColumn("block", F.shiftright("place", 33)))
    digits = _digits(keys)
    ends = now.agg(*[f(d).alias(f"{name}{k}") for k, d in enumerate(digits) for name, f in (("least", F.min), ("most", F.max))]).first()
    varying = [d for k, d in enumerate(digits) if ends[f"least{k}"] != ends[f"most{k}"]]
    for digit in varying or digits[:1]:
        now = stored(_counting_pass(now.withColumn("digit", digit)))
    return now.drop("block")


def _counting_pass(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # of 2^BITS rows at most
    firsts = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(firsts), "digit")
    offsets = offsets.select("digit", "block", (F.col("first") + F.col("ahead")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place"))
    placed = rows.join(offsets, ["digit", "block"]).withColumn("place", F.col("offset") + nth - 1)
    return placed.withColumn("block", F.floor(F.col("place") / BLOCK)).select(*[c for c in rows.columns if c != "digit"])
