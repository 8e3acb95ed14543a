"""Keys of materials and requests, and which of them meet."""

from pyspark.sql import functions as F

from papershed.operators import identity as I

SCHEMA = "id int, fetched_s int, url string, final_url string, aliases array<string>, canonical string, doi string, arxiv string"


def test_keys_and_who_answers(spark):
    rows = [
        (1, 5, "https://a.org/x?utm_source=q#top", "https://a.org/y", ["https://b.org/", "mailto:x"], "https://c.org/", "10.1/x", None),
        (2, 3, "https://d.org/", None, None, "https://c.org/", "10.1/x", "2401.00001"),
        (3, 9, "ftp://e.org/", "", [], None, "", None),
    ]
    known = spark.createDataFrame(rows, SCHEMA).select("id", "fetched_s", I.record_keys(*map(F.col, ("url", "final_url", "aliases", "canonical", "doi", "arxiv"))).alias("keys"))
    assert {r["id"]: r["keys"] for r in known.collect()} == {
        1: ["url:https://a.org/x", "url:https://a.org/y", "url:https://b.org/", "canonical:https://c.org/", "doi:10.1/x"], 2: ["url:https://d.org/", "canonical:https://c.org/", "doi:10.1/x", "arxiv:2401.00001"], 3: [],
    }
    asked = [(10, "https://a.org/x?fbclid=1"), (11, "https://c.org/"), (12, "https://arxiv.org/abs/2401.00001v3"), (13, "https://none.org/")]
    requests = spark.createDataFrame(asked, "request_id int, url string").select("request_id", I.request_keys(F.col("url")).alias("keys"))
    assert {r[0]: r[1] for r in I.identified(requests, known).collect()} == {10: 1, 11: 2, 12: 2}  # of two with one canonical the first fetched
    fetched = [(20, "https://new.org/", "https://b.org/", "10.1/x", None), (21, "https://new.org/", "https://c.org/", None, None), (22, "https://new.org/", None, "10.1/x", None), (23, "https://d.org/", None, "10.1/x", None)]
    pages = spark.createDataFrame(fetched, "request_id int, url string, declared string, doi string, arxiv string").select("request_id", I.page_keys(*map(F.col, ("url", "declared", "doi", "arxiv"))).alias("keys"))
    # a declared link is a URL that was read (20), never another declaration (21); keys decide in order
    assert {r[0]: r[1] for r in I.identified(pages, known).collect()} == {20: 1, 22: 2, 23: 2}


def test_aliases_join_once(spark):
    df = spark.createDataFrame([(["https://a.org/x"], "https://c.org/", None, ["https://a.org/x?utm_source=1", "https://c.org/", "https://n.org/#a", "https://n.org/", "x"])], "names array<string>, canonical string, aliases array<string>, opened array<string>")
    assert df.select(I.with_aliases(*map(F.col, ("names", "canonical", "aliases", "opened")))).first()[0] == ["https://n.org/"]
