"""Release lists and paper listings, read strictly."""

from papershed.sources import captures as C

OPEN = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom">'
RELEASE = '<entry><id>tag:github.com,2008:Repository/1/{t}</id><updated>2024-01-02T03:04:05Z</updated><link href="{u}"/><content type="html">&lt;p&gt;Notes &amp;amp; more</content></entry>'


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_releases(spark):
    lists = [
        ("a", OPEN + RELEASE.format(t="v1.2", u="https://g.org/v1.2") + "<!-- <entry> --></feed>"), ("b", OPEN + RELEASE.format(t="v1", u="") + "</feed>"), ("c", OPEN + "</feed>"), ("d", OPEN + "<entry>"),
        ("e", '<!DOCTYPE feed [<!ENTITY x "y">]>' + OPEN + "</feed>"), ("f", "<rss/>"), ("g", None), ("h", '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:id>x/<![CDATA[v<2]]></a:id><a:link href="u"/></a:entry></a:feed>'),
    ]
    found = C.releases(spark.createDataFrame(lists, "feed_id string, xml string"))
    assert rows(found, "feed_id", "problem", "tag", "url", "notes", "published_ms") == [
        ("a", None, "v1.2", "https://g.org/v1.2", "<p>Notes &amp; more", 1704164645000), ("b", "no usable entry", None, None, None, None), ("d", "malformed", None, None, None, None), ("e", "dtd", None, None, None, None),
        ("f", "no feed", None, None, None, None), ("g", "malformed", None, None, None, None), ("h", None, "v<2", "u", "", None),
    ]


def test_papers(spark):
    entry = '<entry><id>http://arxiv.org/abs/2401.{k:05}v2</id><title> A &lt; B\n {k}</title><summary><![CDATA[x & y]]></summary><author><name> Ada\nA </name></author><author><name/></author><x:primary_category term="cs.CL"/></entry>'
    listing = OPEN + "".join(entry.format(k=k) for k in range(60)) + "</feed>"
    found = C.papers(spark.createDataFrame([("a", listing), ("b", "<feed>")], "feed_id string, xml string"))
    assert found.count() == 50
    first = found.filter("ord = 7").first()
    assert (first["arxiv_id"], first["title"], first["abstract"], first["authors"], first["category"]) == ("2401.00007", "A < B 7", "x & y", ["Ada A"], "cs.CL")
