"""Queries on reader documents: what pages become, where documents break the grammar, and which are small enough to be shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from papershed.operators import reader as R
from papershed.plans.node_queries import rich_pages
from papershed.sources.folders import kept
from papershed.sources.tables import read

COUNTED = {"headings": "heading", "items": "listItem", "links": "link", "cells": "tableCell", "codes": "code", "notes": "footnoteDefinition", "refs": "footnoteReference"}


def _documents(spark, sf_dir, *only):
    """A page's nodes come from one task, so groups by page are all but made there; nothing is dealt or kept."""
    return R.reader_nodes(rich_pages(spark, sf_dir), only=only)


def reader_documents(spark, sf_dir):
    """How many nodes of each kind every page's document has, and how often something was lost."""
    nodes = _documents(spark, sf_dir, "kind", "losses")
    counts = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in COUNTED.items()]
    dropped = F.max(F.size(F.filter("losses", lambda x: x["fallback"] == "omitted"))).cast("long").alias("omitted")
    return nodes.groupBy("page_id").agg(*counts, dropped)


def _damaged(spark, sf_dir):
    """Documents of which every page with an id of each remainder by six breaks one rule, but for remainder 0."""
    def put(name, value):
        return F.map_concat(F.map_filter("props", lambda k, v: k != name), F.create_map(F.lit(name), F.lit(value)))

    kind, rest = F.col("kind"), F.col("page_id") % 6
    broken = (
        F.when((rest == 1) & (kind == "link"), put("url", "javascript:x")).when((rest == 2) & (kind == "heading"), put("depth", "7")).when((rest == 3) & (kind == "tableCell"), put("colSpan", "0"))
        .when((rest == 4) & (kind == "footnoteDefinition"), put("identifier", ""))
    )
    return _documents(spark, sf_dir, "node", "last", "parent", "kind", "role", "value", "props", "losses").withColumn("props", F.coalesce(broken, "props")).withColumn("kind", F.when((rest == 5) & (kind == "listItem"), "paragraph").otherwise(kind))


def reader_violations(spark, sf_dir):
    """Where documents that were damaged break the grammar."""
    found = R.violations(kept(_damaged(spark, sf_dir), "page_id"))
    return found.filter((F.col("page_id") % 6 != 5) | (F.col("rule") == "misplaced")).groupBy("page_id", "rule").agg(F.count_distinct("node").alias("n"))


def reader_limits(spark, sf_dir):
    """Documents with their size, and whether a reader shows them."""
    return R.within_limits(_documents(spark, sf_dir, "depth", "value", "props"), most_nodes=120)


def page_markdown(spark, sf_dir):
    """The Markdown of every page, links, emphasis, tables and code included."""
    nodes = R.reader_nodes(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return nodes.filter("node = 0").select("page_id", F.char_length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


QUERIES = {f.__name__: f for f in (reader_documents, reader_violations, reader_limits, page_markdown)}

_COUNTS = """
    b AS (SELECT page_id, regexp_extract(html, '(?s)<body>(.*)', 1) AS b FROM pages),
    c AS (SELECT page_id, len(regexp_extract_all(b, '<h[1-6]>')) + 3 AS headings, len(regexp_extract_all(b, '<li>')) + 3 AS items, len(regexp_extract_all(b, '<a href')) + 7 AS links FROM b)"""
ORACLE_SQL = {
    "reader_documents": f"WITH {_COUNTS} SELECT *, 2 AS cells, 1 AS codes, 1 AS notes, 1 AS refs, 3 AS omitted FROM c",
    "reader_violations": f"""WITH {_COUNTS} SELECT page_id, (['unsafe_url', 'bad_value', 'bad_value', 'no_identifier', 'misplaced'])[page_id % 6] AS rule,
        CASE page_id % 6 WHEN 1 THEN links WHEN 2 THEN headings WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 2 * items END AS n FROM c WHERE page_id % 6 <> 0""",
}
