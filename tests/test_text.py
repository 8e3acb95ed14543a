import pytest
from pyspark.sql import functions as F

from papershed.functions import dates as D
from papershed.functions import names as N
from papershed.functions import text as X
from papershed.functions import urls as U


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_gist(spark):
    long = "First sentence is here. " + "word " * 70 + "end."
    sentences = ("A sentence of some length that ends. " * 12).strip()
    assert one(spark, X.gist, " short   text ", sentences, "x" * 400) == ["short text", ("A sentence of some length that ends. " * 8).strip(), "x" * 300 + "…"]
    assert one(spark, X.gist, long)[0].endswith("word…")
    assert one(spark, X.gist, "x" * 120 + ". " + "y" * 177 + "." + "z" * 100) == ["x" * 120 + "."]  # a mark at the window's end is no sentence end


def test_reading_minutes(spark):
    assert one(spark, X.reading_minutes, "", "word " * 240, "word " * 360, "漢" * 400, "漢" * 200 + " word" * 240) == [1, 1, 2, 1, 2]
    assert one(spark, X.word_count, "漢，字。「かな」", "one two") == [4, 2]


def test_canonical_urls(spark):
    every = "ref ref_src fbclid gclid dclid msclkid mc_cid mc_eid igshid _hsenc _hsmi mkt_tok yclid spm share utm_source utm_x".split()
    given = {
        "HTTPS://Ex.Com/A?utm_source=x&b=1&UTM_y=2#top": "https://ex.com/A?b=1&UTM_y=2", "http://a.b/?fbclid=1": "http://a.b/", "http://a.b/p?q": "http://a.b/p?q", "http://a.b": "http://a.b/",
        "not a url": "not a url", "https://a.b/?" + "&".join(f"{n}=1" for n in every) + "&id=7": "https://a.b/?id=7", "https://a.b/?x=1&&y=%20": "https://a.b/?x=1&&y=%20",
        "https://api.github.com/c?ref=main&utm_a=1": "https://api.github.com/c?ref=main", "https://x.com/i?s=20": "https://x.com/i", "https://blog.org/?s=find": "https://blog.org/?s=find",
        "https://m.youtube.com/w?v=1&si=2": "https://m.youtube.com/w?v=1", "https://notx.com/?s=1": "https://notx.com/?s=1",
    }
    assert one(spark, U.canonical_url, *given) == list(given.values())


def test_public_and_safe_urls(spark):
    good = ["http://example.org", "https://example.org:8080/x", "https://172.32.0.1/", "HTTP://Example.org/@a", "https://[2001:db8::1]/"]
    bad = ["ftp://example.org", "http://user@example.org/", "http://localhost/", "http://10.1.2.3/", "http://100.64.0.1/x", "http://printer.local", "x", "http://[::1]/", "https://[fd00::1]:80/", "http://[::ffff:10.0.0.1]/", "http://a.internal/"]
    assert one(spark, U.is_public_url, *good, *bad) == [True] * len(good) + [False] * len(bad)
    assert one(spark, U.safe_link, "HTTP://Ex.org?a", "mailto:A@b.c", "javascript:x", "https://u:p@x.y/", "https://x.y/\n", "https://x.y/" + "z" * 9000) == ["http://ex.org/?a", "mailto:A@b.c", None, None, None, None]


def test_canonical_links(spark):
    page = F.lit("https://www.example.org/a/b?utm_x=1")
    found = one(spark, lambda v: U.canonical_link(v, page), "/a/c", "https://example.org/", "https://m.example.org/x?utm_a=1", "https://other.org/x", "/a/b", "", None, "c")
    assert found == ["https://www.example.org/a/c", None, "https://m.example.org/x", None, None, None, None, "https://www.example.org/a/c"]


def test_identifiers(spark):
    assert one(spark, X.arxiv_id, "https://arxiv.org/pdf/2401.01234v3", "http://arxiv.org/abs/hep-th/9901001", "https://evil.org/abs/2401.01234", "2401.01234") == ["2401.01234", "hep-th/9901001", None, None]
    assert one(spark, X.normal_arxiv_id, "arXiv:2401.01234v3", "2401.01234", "", None, "other") == ["2401.01234", "2401.01234", None, None, "other"]
    assert one(spark, X.doi, "https://doi.org/10.1000/ABC", "doi: 10.1000/x", "11/x", None) == ["10.1000/abc", "10.1000/x", None, None]


def test_versions(spark):
    order = ["v1.2.3-1", "1.2.3-alpha", "v1.2.3-alpha.1", "v1.2.3-rc.9", "1.2.3-rc.10", "v1.2.3", "1.2.10", "v1.2.20240102030405", "v2.0.0-x", "v10.0.0+build"]
    assert one(spark, X.version_key, "1.2", "x", "v1.2.3-", "v1.2.3-a..b", None) == [None] * 5
    df = spark.createDataFrame([(t,) for t in order[::-1]], "v string")
    assert [r[0] for r in df.orderBy(X.version_key(F.col("v"))).collect()] == order


def test_normal_dates(spark):
    given = {"2024": "2024", "2024-3": "2024-03", " 2024/03/9 ": "2024-03-09", "2024.5": "2024-05", "May 12, 2024": "2024-05-12", "12 Sept 2024": "2024-09-12", "2024-05-12T10:00:00+02:00": "2024-05-12T08:00:00.000Z", "soon": None, "": None}
    assert one(spark, D.normal_date, *given, None) == [*given.values(), None]


def test_feed_dates(spark):
    given = {
        "Tue, 02 Jan 2024 00:00:01 GMT": 1704153601, "2 Jan 70 10:00 EST": 140400, "1 Jan 49 00:00 Z": 2493072000, "32 Jan 2024 00:00 GMT": None, "29 Feb 2023 00:00 GMT": None, "yesterday": None,
        "1 Jan 1970 00:00 A": -3600, "1 Jan 1970 00:00 M": -43200, "1 Jan 1970 00:00 N": 3600, "1 Jan 1970 00:00 Y": 43200, "1 Jan 1970 00:00 J": None, "1 Jan 1970 25:99 GMT": None,
        "1 Jan 1970 00:00 XYZ": None, "1 Jan 1970 00:00 +0090": None, "1 jan 1970 00:00 GMT": None, "1 Jan 1970 00:00 -0130": 5400,
    }
    assert one(spark, lambda v: D.rss_millis(v) / 1000, *given, None) == [*given.values(), None]
    atom = {
        "2024-01-02T00:00:01Z": "2024-01-02T00:00:01.000Z", "2024-01-02T00:00:01.5+01:30": "2024-01-01T22:30:01.500Z", "2016-12-31T23:59:60Z": "2017-01-01T00:00:00.000Z", "2016-12-31T18:59:60-05:00": "2017-01-01T00:00:00.000Z",
        "2016-12-30T23:59:60Z": None, "2024-02-30T00:00:00Z": None, "2024-01-02": None, "2024-01-02T24:00:00Z": None, "1969-12-31T23:59:59Z": "1969-12-31T23:59:59.000Z",
    }
    assert one(spark, lambda v: D.iso_of_millis(D.atom_millis(v)), *atom) == list(atom.values())


def test_shown_days(spark):
    given = {
        "on 2024-03-05 and later": "2024-03-05", "Sept. 7, 2023": "2023-09-07", "7th September 2023": "2023-09-07", "2024-01-01 then 2019年9月5日": "2019-09-05", "2024-99-99": None, "Feb 30, 2024": None,
        "July 2023 essay": "2023-07-01", "x" * 300 + " July 2023": None, "2024/5/3": None, "none": None,
    }
    assert one(spark, D.shown_day, *given) == list(given.values())
    urls = {"https://a.b/2015/05/21/slug": "2015-05-21", "https://a.b/2023-04/x": "2023-04-01", "https://a.b/2024/Dec/3/x": "2024-12-03", "https://a.b/p/20240101": None, "https://a.b/x?d=/2015/05/21/": None}
    assert one(spark, D.url_day, *urls) == list(urls.values())


def test_titles(spark):
    row = lambda *values: spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    keep = lambda t, e, s: row(t, e, s).select(N.without_site(F.col("c0"), F.col("c1"), F.col("c2"))).first()[0]
    assert keep("Design a cache - Azure Center", "Design a cache", None) == "Design a cache"
    assert keep("Site | A title", None, "SITE") == "A title" and keep("A — B — Site", "x", "site") == "A — B"
    assert keep("Plain", None, "Site") == "Plain" and keep("A - B", None, None) == "A - B"
    choose = lambda *c: row(*c).select(N.chosen_title(F.array(*[F.col(f"c{k}") for k in range(len(c))]), F.array(F.lit("my blog"), F.lit("blog")))).first()[0]
    assert choose("My Blog", "12", "# GPS ¶", "x") == "GPS" and choose("Web Vitals Stay organized", "Web Vitals | My Blog") == "Web Vitals" and choose(None, "My Blog") == "My Blog"


def test_names(spark):
    assert one(spark, N.clean_byline, "By  Ada Lovelace, View all posts by Ada", "作者： 阮一峰", "by", "x" * 130, "Sameer Ajmani 13 March 2014") == ["Ada Lovelace", "阮一峰", None, None, "Sameer Ajmani"]
    found = one(spark, N.creators_of_byline, "By Ada Lovelace, Charles Babbage and Alan Turing")[0]
    assert [c["name"] for c in found] == ["Ada Lovelace", "Charles Babbage", "Alan Turing"]
    assert tuple(one(spark, N.creator, "Lovelace,  Ada")[0]) == ("author", "Ada Lovelace", "Ada", "Lovelace")
    cite = lambda text: one(spark, lambda v: N.citation_names(N.creators_of_byline(v)), text)[0]
    assert [cite(t) for t in ("A", "A, B", "A, B, C", "A, B, C, D")] == ["A", "A and B", "A, B and C", "A et al."]


def test_bibtex(spark):
    author = N.creator(F.lit("Lindqvist, Åsa"))
    fields = "kind title publication volume issue pages publisher place edition series date doi isbn issn arxiv_id url extra accessed".split()
    values = {"kind": "journalArticle", "title": "Retrieval & {more}", "publication": "J", "pages": "3 – 9", "date": "2026-02", "doi": "10.1/x"}
    meta = F.struct(*[F.lit(values.get(f)).cast("string").alias(f) for f in fields], F.array(author).alias("creators"))
    entry = spark.range(1).select(N.bibtex(meta, F.lit("id"))).first()[0]
    assert entry == "@article{lindqvist2026retrieval,\n  author = {Lindqvist, Åsa},\n  title = {{Retrieval \\& \\{more\\}}},\n  journal = {J},\n  pages = {3--9},\n  year = {2026},\n  month = feb,\n  doi = {10.1/x}\n}"


def test_pictures(spark):
    given = {"https://www.a.org/p/Photo-1024x768.JPG?w=1": ("a.org/p/photo-1024x768.jpg", None), "https://cdn.org/w_640,c_limit/v1/A%20b/resize:fit:9/Cat-300x200@2x.jpg": ("cdn.org/a b/cat-300x200@2x.jpg", "cat"), "https://a.org/%E0%A4%A/dog_thumb-scaled.png": ("a.org/%e0%a4%a/dog_thumb-scaled.png", "dog"), "https://s.com/image/fetch/w_1,c_2/https%3A%2F%2Fa.org%2Fp%2Fx.png": ("a.org/p/x.png", "x"), "https://n.com/_next/image?url=https%3A%2F%2Fa.org%2Fy.webp&w=9": ("a.org/y.webp", "y"), "https://a.org/max/1400/image.png": ("a.org/image.png", None)}
    assert list(zip(one(spark, U.image_path, *given), one(spark, U.image_stem, *given))) == list(given.values())
    sets = {"a.jpg 320w, b.jpg 640w": "b.jpg", "a.jpg, b.jpg 2x, c.jpg 2x": "b.jpg", "w_1,c_2/a.jpg 5w": "w_1,c_2/a.jpg", "a.jxl 9w, data:x 99w, b.png 1w": "b.png", "a.png 0w": None, "": None}
    assert one(spark, U.largest_in_srcset, *sets) == list(sets.values())


@pytest.mark.parametrize("text, limit", [("abc", 2), ("aé", 2), ("aé", 3), ("漢字", 4), ("🙂🙂", 7), ("🙂🙂", 8), ("", 3), ("é" * 9, 7)])
def test_byte_cuts(spark, text, limit):
    want = text.encode()[:limit].decode("utf-8", "ignore")
    assert one(spark, lambda v: X.cut_to_bytes(v, limit), text) == [want]


def test_entities(spark):
    assert one(spark, X.entities_decoded, "a &amp;lt; &lt;b&gt; &#39;&#x4e2d; &nope; &#xD800;&", "plain") == ["a &lt; <b> '中 &nope; &#xD800;&", "plain"]


def test_keys_and_slugs(spark):
    assert one(spark, X.comparison_key, "Ünï-code: 42!") == ["ünïcode42"]
    assert one(spark, U.slug, "https://www.Example.org/A b/c?x#y", "http://a.b/") == ["example-org-a-b-c", "a-b"]
    assert one(spark, N.heading_key, "  The  End?!. ") == ["the end"]
