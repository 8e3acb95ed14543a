"""Queries on lineage: every document is made from the one with half its number, every third by the agent."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.operators import lineage as L
from papershed.sources.tables import read


def _id(n):
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def _records(spark, sf_dir):
    n = F.col("doc_id")
    made_from = F.when(n > 0, F.array(_id(F.floor(n / 2)))).otherwise(F.array(_id(n)))  # the first is its own origin: a cycle
    return read(spark, sf_dir, "documents").select(_id(n).alias("id"), n, F.when(n % 3 == 0, "agent").otherwise("web").alias("origin"), made_from.alias("lineage"))


def lineage_depths(spark, sf_dir):
    """How many materials each material goes back to."""
    return L.ancestors(_records(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


def rebuilt_artifacts(spark, sf_dir):
    """Replies that name three ids and tools that wrote one: which artifact replaces each material."""
    records = _records(spark, sf_dir)
    n = F.col("doc_id")
    text = F.concat(F.lit("See "), _id(3 * n + 1), F.lit(" and "), _id(2 * n), F.lit(", "), _id(4 * n + 3), F.lit("."))
    tools = F.array(F.struct(F.lit("artifact_write").alias("name"), F.when(n % 2 == 0, "done").otherwise("failed").alias("status"), F.concat(F.lit("artifact_write x → "), _id(4 * n + 1)).alias("summary")))
    asked = records.select("id", L.candidates(text, tools).alias("candidates"))
    return L.rebuilt(asked, records, L.ancestors(records))


QUERIES = {f.__name__: f for f in (lineage_depths, rebuilt_artifacts)}

_REACH = "reach AS (SELECT doc_id AS id, doc_id // 2 AS ancestor FROM documents UNION SELECT r.id, d.doc_id // 2 FROM reach r JOIN documents d ON d.doc_id = r.ancestor)"
_HEX = "lpad(lower(to_hex({})), 16, '0')"
ORACLE_SQL = {
    "lineage_depths": f"WITH RECURSIVE {_REACH} SELECT {_HEX.format('id')} AS id, count(*) AS n FROM reach GROUP BY id",
    "rebuilt_artifacts": f"""WITH RECURSIVE {_REACH},
        c AS (SELECT doc_id AS m, unnest(CASE WHEN doc_id % 2 = 0 THEN [4 * doc_id + 1] ELSE [] END || [3 * doc_id + 1, 2 * doc_id, 4 * doc_id + 3]) AS c,
                     generate_subscripts(CASE WHEN doc_id % 2 = 0 THEN [4 * doc_id + 1] ELSE [] END || [3 * doc_id + 1, 2 * doc_id, 4 * doc_id + 3], 1) AS place FROM documents),
        f AS (SELECT m, c, place FROM c WHERE c % 3 = 0 AND c IN (SELECT doc_id FROM documents) AND EXISTS (SELECT 1 FROM reach WHERE reach.id = c.c AND reach.ancestor = c.m))
        SELECT {_HEX.format('m')} AS id, {_HEX.format('arg_min(c, place)')} AS rebuilt_as FROM f GROUP BY m""",
}
