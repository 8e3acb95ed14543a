"""Queries on small tables with rows that the given tables lack at their smallest size: they have their SQL's rows."""

import duckdb

from papershed.plans import registry


def same_rows(spark, folder, name, **tables):
    """Asserts that a query and its SQL agree on ``tables`` (schema, rows), and returns the rows."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = registry.QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    rows = sorted((tuple(r) for r in found.select(columns).collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


PAGES, DOCUMENTS = "page_id long, url string, html string", "doc_id long, text string, lang string, source string, n_chars long"


def test_an_address_with_several_pictures_keeps_each(spark, tmp_path):
    pages = [(2, "http://a.org/x", "one"), (6, "http://a.org/x", "three"), (10, "http://a.org/x", "three"), (4, "http://a.org/y", "é"), (8, "http://a.org/z", "z"), (14, "http://a.org/z", "zz")]
    assert len(same_rows(spark, tmp_path, "image_cache", pages=(PAGES, pages))) == 3


def test_releases_under_one_tag_stay_releases(spark, tmp_path):
    docs = [(i, "text", "en", "s", 4) for i in (10000, 100000, 100001, 100002, 7)]
    assert len(same_rows(spark, tmp_path, "release_list", documents=(DOCUMENTS, docs))) == 5


def test_notes_keep_their_places_in_capitals(spark, tmp_path):
    texts = ["straße süß 1 2 3 x", "ﬁ ß AB CD EF g", "ŉ ᾳ ǰ Ω 2 ΐ", "a b ẞ 1 2 c", "ß b c d e f"]
    rows = same_rows(spark, tmp_path, "mirrored_notes", documents=(DOCUMENTS, [(2 * k + 1, t, "de", "s", len(t)) for k, t in enumerate(texts)]))
    assert len([r for r in rows if "text" in r]) == 4 and any({"text", 11, 16} < set(r) for r in rows)


CUT = (28, "http://a.org/c", "<html><head><title>A &amp</title></head><body><article><h1>A &amp</h1><p>One &amp; two &copy; AT&T &lt;b&gt;.</p></article></body></html>")


def test_references_cut_short_are_text(spark, tmp_path):
    same_rows(spark, tmp_path / "s", "page_content_stats", pages=(PAGES, [CUT]))


def test_references_cut_short_are_text_in_rewritten_pages(spark, tmp_path):
    same_rows(spark, tmp_path / "r", "rewritten_pages", pages=(PAGES, [CUT]))
