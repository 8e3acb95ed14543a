"""Lineage of materials: what each was made from, however far back, and the artifact that a rebuild made.

``ancestors`` doubles the reach of known pairs each round, so a lineage of depth 1,000 takes about ten rounds; a cycle adds no
new pair and ends like any other lineage. Each round is kept in the shared folder. Only pairs exactly so many steps apart as the round
doubles meet the others, so a pair of a tree is made once, and only they are shuffled for it; the others stay where they lie by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.sources.folders import kept, spread

#: Sixteen hexadecimal digits that stand alone: an id in a reply; what a finished tool says it wrote.
ID_IN_TEXT, WRITTEN = r"\b([a-f0-9]{16})\b", r"^artifact_write .* → ([a-f0-9]{16})$"


def ancestors(records: DataFrame) -> DataFrame:
    """``id, ancestor``: all pairs of a record and what is in its lineage, or in that of its lineage, and so on; records have ``id, lineage``.

    A row is ``far`` if it stands for the steps that its round doubles, 2^r of them; others are at hand, up to 2^r - 1 steps. What leads back to itself goes no further.
    """
    far = ~F.col("id").eqNullSafe(F.col("ancestor")) & F.col("ancestor").isNotNull()

    def settled(rows: DataFrame) -> tuple[DataFrame, int, int]:
        now = kept(spread(rows, "id").distinct())
        return now, *now.agg(F.count_if(~F.col("far")), F.count_if("far")).first()

    now, size, ahead = settled(records.select("id", F.explode("lineage").alias("ancestor")).withColumn("far", far))
    while ahead:
        steps = now.filter("far").select(F.col("id").alias("_id"), F.col("ancestor").alias("id"))
        beyond = now.join(steps, "id").select(F.col("_id").alias("id"), "ancestor", "far").withColumn("far", F.col("far") & far)
        was = size
        now, size, ahead = settled(now.select("id", "ancestor", F.lit(False).alias("far")).union(beyond))
        if size == was:
            break
    return now.filter("not far").select("id", "ancestor")


def candidates(text: Column, tools: Column) -> Column:
    """Ids that a reply may have made, in order: those that finished tools (array of struct<name, status, summary>) wrote, then those in the text; each once."""
    done = F.filter(tools, lambda t: (t["name"] == "artifact_write") & (t["status"] == "done"))
    written = F.filter(F.transform(done, lambda t: F.regexp_extract(F.coalesce(t["summary"], F.lit("")), WRITTEN, 1)), lambda i: i != "")
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ID_IN_TEXT), F.lit(1))
    return F.array_distinct(F.concat(F.coalesce(written, F.array().cast("array<string>")), said))


def rebuilt(asked: DataFrame, records: DataFrame, reach: DataFrame) -> DataFrame:
    """``id, rebuilt_as`` of materials that a reply rebuilt: of ``asked`` (``id, candidates``) the first candidate that is a material of the agent
    (``records``: ``id, origin``) and has the original among its ancestors (``reach``)."""
    tried = asked.select("id", F.posexplode("candidates").alias("place", "candidate"))
    made = records.filter("origin = 'agent'").select(F.col("id").alias("candidate"))
    from_it = spread(reach.select(F.col("id").alias("candidate"), F.col("ancestor").alias("id")), "candidate", "id")
    met = tried.join(made, "candidate").join(from_it, ["candidate", "id"], "left_semi")
    return met.groupBy("id").agg(F.min_by("candidate", "place").alias("rebuilt_as"))
