"""Reading order against what was set, and small pages that a glance can check."""

import re

import pytest
from pyspark.sql import functions as F

from papershed.operators import layout as L
from papershed.plans import layout_queries as Q

RUN = "doc int, page int, seq int, text string, x double, y double, w double, h double, baseline double, size double, bold boolean, rotated boolean"


def runs(spark, rows):
    """Rows (page, text, x, baseline) with (width, size, bold) to follow."""
    full = [(1, r[0], k, r[1], float(r[2]), float(r[3]) - 8, float(r[4] if len(r) > 4 else 6 * len(r[1])), 10.0, float(r[3]), float(r[5] if len(r) > 5 else 10), bool(r[6]) if len(r) > 6 else False, False) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, RUN)


def test_lines_by_baseline_and_gap(spark):
    rows = [(0, "one", 10, 20), (0, "two", 35, 22), (0, "far", 200, 20), (0, "next", 10, 32), (0, "bold", 40, 32, 24, 10, True)]
    found = [(r["text"], r["x"]) for r in L.lines(runs(spark, rows)).orderBy("baseline", "x").collect()]
    assert found == [("one two", 10.0), ("far", 200.0), ("next bold", 10.0)]


def test_degraded_pages(spark):
    rows = [(0, "�" * 4 + "abc", 0, 10), (1, "fine words here", 0, 10), (2, "x" * 300, 0, 10)]
    assert sorted(r["page"] for r in L.degraded_pages(runs(spark, rows)).collect()) == [0, 2]


def test_paragraphs_headings_and_hyphens(spark):
    full = "a line of text that is as wide as it goes"
    rows = [(0, "1.2 Results", 10, 20, 80, 12), (0, full + " infor-", 10, 40, 300), (0, "mation ends here.", 10, 52, 100), (0, "• item one", 10, 64, 60), (0, "Figure 1: Seen", 10, 90, 90), (0, full, 10, 120, 300), (1, "goes on here.", 10, 20, 80), (1, full + ".", 10, 60, 300)]
    placed = L.placed_lines(L.pages_of(L.lines(runs(spark, rows)), 600.0))
    found = [(r["kind"], r["text"]) for r in L.blocks(placed).orderBy("block").collect()]
    assert found == [("heading", "1.2 Results"), ("paragraph", full + " information ends here."), ("item", "• item one"), ("caption", "Figure 1: Seen"), ("paragraph", full + " goes on here."), ("paragraph", full + ".")]
    sure = L.certain(L.blocks(placed), words=5)
    assert [r["certain"] for r in sure.orderBy("block").collect()] == [False, True, False, False, False, True]
    verdicts = spark.createDataFrame([(1, 3, "furniture", 0.8), (1, 2, "heading", 0.9), (1, 5, "item", 0.7)], "doc int, block long, kind string, confidence double")
    assert [r["kind"] for r in L.judged(sure, verdicts).orderBy("block").collect()] == ["heading", "paragraph", "caption", "paragraph", "paragraph"]


@pytest.fixture(scope="module")
def set_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80)
    return docs, {r["doc_id"]: [w for w in re.split(r"\s+", r["text"] or "") if w] for r in docs.collect()}


def test_two_columns_are_read_as_they_were_set(spark, set_texts):
    docs, words = set_texts
    placed = L.placed_lines(L.pages_of(L.lines(Q.runs_of(docs)), Q.WIDTH))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", "text"))), lambda p: p["text"])
    found = {r["doc"]: r["t"] for r in placed.groupBy("doc").agg(F.array_join(parts, " ").alias("t")).collect()}
    seen = 0
    for doc, w in words.items():
        pages = [w[k : k + 360] for k in range(0, len(w), 360)]
        if any(30 < -(-len(p) // 6) < 36 for p in pages):
            continue  # a second column of a few lines is none by the rules
        seen += len(pages) > 1
        assert found.get(doc, "") == " ".join(f"Part {k + 1} {' '.join(p)}" for k, p in enumerate(pages))
    assert seen > 5


def test_column_counts(spark, set_texts):
    docs, words = set_texts
    found = {r["doc"]: r["columns"] for r in L.dominant_columns(L.pages_of(L.lines(Q.runs_of(docs)), Q.WIDTH)).collect()}
    for doc, w in words.items():
        if len(w) > 720:
            assert found[doc] == 2
        elif 0 < len(w) <= 180:
            assert found[doc] == 1


def test_no_word_is_lost_in_blocks(spark, set_texts):
    docs, words = set_texts
    blocks = L.blocks(L.placed_lines(L.pages_of(L.lines(Q.runs_of(docs)), Q.WIDTH)))
    found = {r["doc"]: r["n"] for r in blocks.groupBy("doc").agg(F.sum(F.char_length(F.regexp_replace("text", r"[\s-]", ""))).alias("n")).collect()}
    for doc, w in words.items():
        heads = sum(len(f"Part{k + 1}") for k in range(-(-len(w) // 360)))
        assert found.get(doc, 0) == len("".join(w).replace("-", "")) + heads


def test_runs_that_lie_together_stay_where_they_are(spark, set_texts):
    docs, _ = set_texts
    there = L.page_lines(Q.runs_of(docs), together=True)
    assert "Exchange hashpartitioning" not in there._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["doc"], r["page"], r["text"], r["x"], r["y"]) for r in L.lines(Q.runs_of(docs).repartition(3)).collect())
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # pages of 361 runs span batches
    try:
        found = sorted((r["doc"], r["page"], r["text"], r["x"], r["y"]) for r in there.select("doc", "page", F.inline("l")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert found == want and len(found) > 500


def test_blocks_deal_the_lines_once(spark, set_texts):
    """Lines are placed where their pages lie, and dealt and sorted once for all of their blocks; windows sorted them again and again, on disk."""
    docs, _ = set_texts
    pages = L.pages_of(L.page_lines(Q.runs_of(docs), together=True), Q.WIDTH)
    assert not any(step in L.placed_lines(pages)._jdf.queryExecution().executedPlan().toString() for step in ("Exchange hashpartitioning", "Sort", "Window"))
    blocks = L.certain(L.blocks(pages))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("Sort ["), plan.count("Window")) == (1, 1, 0)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # documents span batches
    try:
        found = sorted(map(tuple, blocks.select("doc", "block", "text", "kind", "certain").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    placed = L.certain(L.blocks(L.placed_lines(pages).repartition(3)))
    assert found == sorted(map(tuple, placed.select("doc", "block", "text", "kind", "certain").collect())) and len(found) > 100


def test_reports_from_blocks_alone(spark):
    """Pages, also those that no block begins on, come with the blocks in which they begin."""
    full = "a line of text that is as wide as it goes"
    rows = [(0, "Head", 10, 20, 80, 20), (0, full, 10, 60, 300), *[(p, full, 10, 20 + 12 * k, 300) for p in (1, 2) for k in range(9)], (3, "x" * 300, 10, 20, 300)]
    blocks = L.certain(L.blocks(L.placed_lines(L.pages_of(L.lines(runs(spark, rows)), 600.0))), words=5)
    assert [(r["kind"], [tuple(p) for p in r["begun"]]) for r in blocks.orderBy("block").collect()] == [("heading", [(0, 1, 2)]), ("paragraph", [(1, 1, 9), (2, 1, 9), (3, 1, 1)])]
    verdicts = spark.createDataFrame([(1, 1, "furniture", 0.8)], "doc int, block long, kind string, confidence double")
    report = L.report(L.judged(blocks, verdicts), blocks.select("doc", F.inline("begun")), L.degraded_pages(runs(spark, rows))).first()
    assert report.asDict() == {"doc": 1, "pages": 4, "columns": 1, "degraded": 1, "headings": 0, "paragraphs": 1, "items": 0, "captions": 0, "joined": 3}
