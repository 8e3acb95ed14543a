from pyspark.sql import functions as F

from papershed.functions import text
from papershed.operators import inbox, library, reflow, store, turns
from papershed.operators.quotes import anchors
from papershed.streaming import library as streams


def test_tags(spark):
    df = spark.createDataFrame([([" A ", "a", "", "B", "x" * 50, "b "],), ([],), (None,)], "t array<string>")
    found = [r[0] for r in df.select(library.normal_tags(F.col("t"))).collect()]
    assert found == [["A", "B", "x" * 40], [], None]


def test_natural_order(spark):
    titles = ["Alpha", "vol 9", "Vol 10", "Vol 010b", "Vol 00000000000011", "Vol 12345678901234", "Vol 123456789012345"]
    df = spark.createDataFrame([(t,) for t in titles[::-1]], "t string")
    assert [r[0] for r in df.orderBy(text.natural_key(F.col("t"))).collect()] == titles


def test_all_words(spark):
    df = spark.createDataFrame([("The Cat sat",), ("dog",)], "t string")
    assert [r[0] for r in df.select(library.has_all_words(F.col("t"), "cat THE")).collect()] == [True, False]
    assert [r[0] for r in df.select(library.has_all_words(F.col("t"), "  ")).collect()] == [False, False]


def test_nearest_before(spark):
    points = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, at int")
    marks = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, at int, value string")
    found = {(r["k"], r["at"]): r["m"] for r in library.nearest_before(points, marks, "k", "at", "m").collect()}
    assert found == {("a", 1): None, ("a", 5): "y", ("a", 9): "y", ("b", 5): None}


def test_overlaps_once_each(spark):
    a = spark.createDataFrame([("d", 0, 5000), ("d", 90, 100)], "k string, start long, stop long")
    b = spark.createDataFrame([("d", 95, 4000), ("d", 100, 101), ("e", 0, 9)], "k string, start long, stop long")
    found = sorted((r["l_start"], r["r_start"]) for r in library.overlapping(a, b, "k", 64).collect())
    assert found == [(0, 95), (0, 100), (90, 95)]


def test_upsert_keeps_decisions(spark):
    stored = spark.createDataFrame([("s", 1, "old", 7), ("s", 2, "two", None)], "source string, ext int, title string, kept int")
    batch = spark.createDataFrame([("s", 1, "new", None, 1), ("s", 1, "newer", None, 2), ("s", 3, "three", 5, 1)], "source string, ext int, title string, kept int, ord int")
    found = sorted(map(tuple, inbox.upsert(stored, batch, ["source", "ext"], ["title"], "ord").collect()))
    assert found == [("s", 1, "newer", 7), ("s", 2, "two", None), ("s", 3, "three", 5)]


def test_anchors_ignore_white_space(spark):
    quotes = spark.createDataFrame([(1, "quick brown fox jumps over it"), (2, "shorts")], "quote_id int, text string")
    texts = spark.createDataFrame([(1, "A quick\nbrown  fox jumps over it. quick brownfox jumps over it"), (2, "none")], "text_id int, text string")
    assert [tuple(r) for r in anchors(quotes, texts).collect()] == [(1, 1, 1, 2)]


def test_folds_runs(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabbba")] + [(1, 6, None), (1, 7, None)], "c int, n int, v string")
    found = sorted((r["first"], r["v"], r["n"]) for r in turns.folded(df, "c", "n", "v").collect())
    assert found == [(0, "a", 2), (2, "b", 3), (5, "a", 1), (6, None, 2)]


def test_reflow_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = reflow.lines(reflow.runs_of(spark, docs))
    found = {}
    for r in reflow.blocks(reflow.without_furniture(rows)).collect():
        found.setdefault(r["doc"], []).append(r)
    import re

    for doc in docs.limit(60).collect():
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", doc["text"].strip(" ")) if w]
        lines = [words[k : k + 8] for k in range(0, len(words), 8)]
        sized = [(14.0 if k % 40 % 10 == 0 else 10.0, " ".join(x), k // 40) for k, x in enumerate(lines)]
        weight = {14.0: 0, 10.0: 0, 8.0: 0}
        for size, text, _ in sized:
            weight[size] += len(text)
        pages = sized[-1][2] + 1
        if pages < 2:  # no furniture is found on one page; heads and numbers stay
            continue
        body = max(weight, key=lambda s: (weight[s], s))
        blocks = []
        for size, text, _ in sized:
            heading = size >= 1.15 * body
            if heading or not blocks or blocks[-1][0]:
                blocks.append([heading, [text]])
            else:
                blocks[-1][1].append(text)
        mine = sorted(found[doc["doc_id"]], key=lambda r: r["block"])
        plain = "\n\n".join(" ".join(b[1]) for b in blocks)
        if len({r["masked"] for r in reflow.furniture(rows.filter(F.col("doc") == doc["doc_id"])).collect()} - {"head", "#"}):
            continue  # body lines that repeat at one height are furniture as well
        assert [r["text"] for r in mine] == [" ".join(b[1]) for b in blocks]
        assert all(plain[r["start"] :].startswith(r["text"]) for r in mine)
        break


def test_stream_upserts_by_batch(spark, tmp_path):
    for k, rows in enumerate([[(1, "a"), (2, "b")], [(2, "B"), (3, "c")]]):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/in")
        streams.upsert_batches(stream, f"{tmp_path}/out", ["id"])
    assert sorted(map(tuple, store.load(spark, f"{tmp_path}/out").select("id", "v").collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_requests_stay_in_their_budget(spark):
    from papershed.operators import details

    rows = [[5, 5, 1], [20, 1, 1], [], [3, 3, 3, 3]]
    df = spark.createDataFrame([(r,) for r in rows], "n array<bigint>")
    assert [r[0] for r in df.select(details.batched(F.col("n"), 10)).collect()] == [[0, 0, 1], [0, 1, 1], [], [0, 0, 0, 1]]


def test_feeds_with_faults():
    from papershed.sources import feeds

    assert [r[2] for x in (b"", b"<rss", b"<!DOCTYPE a><rss/>", b"<other/>") for r in feeds.entries("f", x)] == ["empty", "malformed", "dtd", "no_feed"]
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><id>1</id><title>E</title><link href="u"/><updated>2024-01-01</updated><summary>s</summary></entry></feed>'
    assert feeds.entries("f", atom) == [("f", True, None, "T", 0, "1", "E", "u", None, "2024-01-01", "s")]
    many = b"<rss><channel>" + b"<item><guid>1</guid></item>" * 201 + b"</channel></rss>"
    assert feeds.entries("f", many)[0][2] == "too_many_entries"


def test_reflow_makes_lines_where_the_runs_lie(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    runs = reflow.runs_of(spark, docs)
    there = reflow.lines(runs, together=True)
    assert "Exchange hashpartitioning" not in there._jdf.queryExecution().executedPlan().toString()
    order = ["doc", "page", "y", "size", "text"]
    assert sorted(map(tuple, there.select(order).collect())) == sorted(map(tuple, reflow.lines(runs.repartition(3)).select(order).collect()))


def test_listed_citations_move_no_list_of_a_single_row(spark):
    from papershed.operators import details as D

    lists = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, None), (3, []), (4, ["x", "y"]), (4, ["z", "x", "w"]), (None, ["q"]), (None, ["p", "q"])], "doc long, refs array<string>")
    expect = {(1, "b", 1), (1, "a", 2), (1, "", 3), (4, "x", 1), (4, "z", 2), (4, "y", 3), (4, "w", 4), (None, "p", 1), (None, "q", 2)}
    rows = [tuple(r) for r in D.listed_citations(lists).collect()]
    assert set(rows) == expect and len(rows) == len(expect)
    assert "Exchange" not in D.listed_citations(lists.filter("doc < 4"))._jdf.queryExecution().executedPlan().toString()


def test_reflow_deals_the_lines_once(spark, sf_dir):
    """One shuffle and one sort of a document's lines for furniture and blocks; joins and windows sorted them again and again, on disk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = reflow.lines(reflow.runs_of(spark, docs), together=True)
    blocks = reflow.blocks(reflow.without_furniture(rows), together=True)
    for made in (reflow.furniture(rows), blocks):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Exchange"), plan.count("Sort ["), plan.count("Join"), plan.count("Window")) == (1, 1, 0, 0)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents span batches
    try:
        found = sorted(map(tuple, blocks.select("doc", "block", "heading", "page", "text", "start").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    again = reflow.blocks(reflow.without_furniture(rows).repartition(3)).select("doc", "block", "heading", "page", "text", "start")
    assert found == sorted(map(tuple, again.collect())) and len(found) > 500


def test_furniture_of_small_documents(spark):
    """Lines at one height on enough pages, digits aside; a document without an id has none, and no blocks."""
    rows = [(d, p, y, 10.0, t) for d in (1, 2, None) for p in range(3 if d != 2 else 1) for y, t in ((0, f"Page {p}"), (1, "same" if p < 2 else "other"), (2, f"text {'abc'[p]}"))]
    lines = spark.createDataFrame(rows, "doc int, page int, y int, size double, text string")
    assert sorted(map(tuple, reflow.furniture(lines).collect())) == [(1, 0, "page #", 3), (1, 1, "same", 2)]
    left = reflow.without_furniture(lines)
    assert left.columns == lines.columns and sorted((r["page"], r["text"]) for r in left.filter("doc = 1").collect()) == [(0, "text a"), (1, "text b"), (2, "other"), (2, "text c")]
    assert left.filter("doc is null").count() == 9 and left.filter("doc = 2").count() == 3
    blocks = [tuple(r) for r in reflow.blocks(left).orderBy("doc").select("doc", "block", "heading", "page", "text", "start").collect()]
    assert blocks == [(1, 1, False, 0, "text a text b other text c", 0), (2, 1, False, 0, "Page 0 same text a", 0)]
