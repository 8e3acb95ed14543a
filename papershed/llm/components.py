"""Connected components by alternating stars, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import stored


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the component's smallest node.

    Each round links all larger neighbours of a node, then all smaller ones, to its smallest
    neighbour, until nothing changes. Rounds are written to reliable storage. Nothing is
    gathered per node: neighbours meet in joins, whose large partitions Spark can split.
    """
    now = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v").distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least)
        now = stored(small.distinct())
        was, mark = mark, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
