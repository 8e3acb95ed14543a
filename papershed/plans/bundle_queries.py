"""Queries on evaluation files that Spark writes from the tables and reads back."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from papershed.sources import bundles as B
from papershed.sources import versions as V
from papershed.sources.folders import new_folder
from papershed.sources.tables import read


#: Pages that are packed at a time.
ROWS = 64


def _bundles(spark, sf_dir):
    """A feedback bundle for every page: its report and its html; some name another view, have no report, or are cut short."""

    def of(i: int, url: str, html: str) -> bytes:
        out, top = io.BytesIO(), "" if i % 2 else "report-1/"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            if i % 11 != 5:
                z.writestr(f"{top}report.json", json.dumps({"url": url, "view": ["web", "pdf", "feed"][i % 3], "kinds": ["layout", "text"][: i % 3]}))
            z.writestr(f"{top}page.html", html)
            z.writestr("__MACOSX/x", b"")
        return out.getvalue()[: -7 if i % 13 == 4 else None]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # a few pages at a time are there twice
                rows = batch.slice(at, ROWS)
                made = [of(*row.values()) for row in rows.to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), pa.array(made, pa.binary())], ["page_id", "content"])

    return read(spark, sf_dir, "pages").select("page_id", "url", "html").mapInArrow(packed, "page_id long, content binary")


def bundle_entries(spark, sf_dir):
    """The files of every page's bundle with size and digest; bundles that are cut short are refused."""
    found = B.bundle_entries(_bundles(spark, sf_dir), "page_id")
    name = F.regexp_replace("name", "^report-1/", "")
    rows = found.filter("name is null or name not like '%report.json'")
    return rows.select("page_id", name.alias("name"), F.octet_length("bytes").alias("size"), F.md5("bytes").alias("md5"), F.col("problem").isNotNull().alias("refused"))


def feedback_import(spark, sf_dir):
    """How many cases every corpus would get from the bundles, and how many are refused."""
    pages = read(spark, sf_dir, "pages").filter("page_id % 5 = 0")
    known = B.feedback_cases(_bundles(spark, sf_dir).join(pages.select("page_id"), "page_id", "left_semi"), "page_id").filter("slug is not null")
    added, refused = B.imported(known.select("slug").distinct(), B.feedback_cases(_bundles(spark, sf_dir), "page_id"), "page_id")
    rows = added.select(F.lit("added").alias("outcome"), "slug").union(refused.select(F.when(F.col("problem").contains("already exists"), "taken").otherwise("refused"), F.lit("")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def exported_results(spark, sf_dir):
    """An export of every document, then one of a third of them of which every ninth fails: what the table has in catalog order."""
    path = new_folder(spark, "exports")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.col("doc_id").alias("place"), F.col("n_chars").alias("size"), F.lit(1).alias("run"))
    V.replace(docs, path, "slug")
    again = docs.filter("place % 3 = 0").withColumn("run", F.lit(2))
    V.replace(again.filter("place % 9 <> 0"), path, "slug", again)
    return V.load(spark, path).groupBy("run").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("place").alias("first"))


def judged_results(spark, sf_dir):
    """Verdicts of results that were written as JSON and read back under a strict schema."""
    path = new_folder(spark, "results")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("slug"), F.struct(F.col("toxic").alias("content"), F.col("quality").alias("rendering")).alias("layers"))
    labels.write.json(path)
    rows = B.judge_results(spark, path, "slug string, layers struct<content:int, rendering:int>", whole=False)
    return rows.select("slug", "layers.content", "layers.rendering")


QUERIES = {f.__name__: f for f in (bundle_entries, feedback_import, exported_results, judged_results)}
ORACLE_SQL = {
    "bundle_entries": """SELECT page_id, CASE WHEN page_id % 13 <> 4 THEN 'page.html' END AS name, CASE WHEN page_id % 13 <> 4 THEN CAST(strlen(html) AS INTEGER) END AS size,
        CASE WHEN page_id % 13 <> 4 THEN md5(html) END AS md5, page_id % 13 = 4 AS refused FROM pages""",
    "exported_results": """SELECT CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS run, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, min(doc_id) AS first FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1""",
    "judged_results": "SELECT CAST(doc_id AS VARCHAR) AS slug, toxic AS content, quality AS rendering FROM labels",
}
