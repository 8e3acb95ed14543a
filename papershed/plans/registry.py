"""Every query of the library by name, with the SQL that states the same answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papershed.plans import bundle_queries, capture_queries, detail_queries, inbox_queries, layout_queries, library_queries, lineage_queries, more_queries, name_queries, node_queries, page_queries, quality_queries, quote_queries, reader_queries, store_queries, stream_queries, tool_queries

MODULES = (bundle_queries, capture_queries, detail_queries, inbox_queries, layout_queries, library_queries, lineage_queries, more_queries, name_queries, node_queries, page_queries, quality_queries, quote_queries, reader_queries, store_queries, stream_queries, tool_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source health: every subscription with its item counts and weekly rate."""
    return QUERIES["source_health"](spark, sf_dir)
