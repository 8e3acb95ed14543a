"""Pages as nodes, and what is read from them, on pages that a glance can check."""

import pytest
from pyspark.sql import functions as F

from papershed.operators import content as C
from papershed.sources import pages as P

PAGE = """<!doctype html><html><head><title>T &amp; U</title><script>var a = '<p>no</p>'</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<main><h1>A story</h1><p>One <b>bold</b> word.<p>Two<br>lines &lt;b&gt;<ul><li>x<li>y <ul><li>z</ul></ul><h2>Next <a href="#next">#</a></h2><blockquote>Said</blockquote><pre>code</pre>
<figure><img src="a.jpg"><figcaption>Seen</figcaption></figure><h2>Related posts</h2><ul><li><a href="/q">Q</a></li></ul></main></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://a.b/c/d", PAGE), (2, "https://a.b/", None), (3, "https://a.b/", "just <i>text"), (4, "https://a.b/", "")], "page_id long, url string, html string")


def test_tree():
    rows = P.tree(PAGE)
    assert [r[0] for r in rows] == list(range(len(rows))) and all(r[1] >= r[0] for r in rows)
    for node, last, parent, depth, *_ in rows:  # intervals nest as parents say
        if parent is not None:
            assert rows[parent][0] < node <= last <= rows[parent][1] and rows[parent][3] == depth - 1
    tags = [r[4] for r in rows]
    assert tags.count("p") == 2 and tags.count("li") == 5 and P.tree(None) == [] and P.tree("") == []
    second = [r for r in rows if r[4] == "p"][1]
    assert "Two" in [r[6] for r in rows if r[2] == second[0]]  # a start of p ends the p before


def test_long_pages_take_linear_time():
    import time

    began = time.process_time()
    for unit in ("<p>word ", "<div>", "<a href=x>", "</b>", "<b>", "<a ", '<a x="', "<a x='", "<![", "<!--", "<title>", "<script>", "</script", "&", '<a x="y>', "</", "<a =", "< "):
        for end in ("", '>"', "</div>"):
            P.tree(unit * (1_000_000 // len(unit)) + end)
    assert time.process_time() - began < 90


def test_end_tags_reach_any_depth():
    rows = P.tree("<div>" + "<b>" * 500 + "</div>after")
    assert rows[-1][4:7] == ["#text", [], "after"] and rows[-1][3] == 0


def test_inside_and_texts(pages):
    nodes = P.page_nodes(pages)
    lists = P.inside(nodes, F.col("tag") == "nav", "in_nav").filter("in_nav and tag = '#text'").select("text").collect()
    assert [r["text"] for r in lists] == ["Home"]
    text = {r["page_id"]: r["content"] for r in P.texts(P.without(nodes, F.col("tag").isin("head", "nav", "script")), ["page_id"]).collect()}
    assert text[1].startswith("A story") and "Home" not in text[1] and text[3] == "just text" and set(text) == {1, 3}


def test_statistics_and_gates(pages):
    nodes = P.page_nodes(pages)
    stats = {r["page_id"]: r for r in C.content_stats(nodes).collect()}
    named = dict(zip(C.UNITS, stats[1]["units"]))
    assert {k: v for k, v in named.items() if v} == {"pre": 1, "figure": 1, "image": 1, "link": 3, "heading": 3, "list": 4}
    assert stats[3]["chars"] == len("just text")
    roots = {r["page_id"]: r["rule"] for r in C.article_roots(nodes).collect()}
    assert roots == {1: "main"}
    row = pages.sparkSession.range(1)
    units = lambda **n: F.array(*[F.lit(n.get(u, 0)) for u in C.UNITS])
    keeps = lambda kept, source: row.select(C.keeps_units(units(**kept), units(**source))).first()[0]
    assert keeps({"table": 6}, {"table": 10}) and not keeps({"table": 5}, {"table": 10}) and not keeps({}, {"pre": 1}) and keeps({}, {"link": 9, "list": 3, "heading": 2})
    candidate = lambda chars: F.struct(units().alias("units"), F.lit(chars).alias("chars"))
    choose = lambda a, b: row.select(C.chosen_candidate(candidate(a), candidate(b), units())).first()[0]
    assert [choose(*c) for c in ((600, 1200), (600, 1201), (599, 80), (10, 79))] == ["first", "second", "second", None]


REGIONS = {
    1: "<nav><picture><img></picture><ul><li>menu</ul></nav><article><h1>A</h1><nav><a href=x>skip</a><script>no</script></nav><picture><img><p>p</p></picture><img> b </article><img>tail",
    2: "<picture><noscript><nav><article><img>\\(x\\) \\(y\\)<iframe><pre>hid</pre></iframe></article></nav></noscript></picture><p>rest <math>z</math></p>",
    3: "<article>one</article><article>two</article><main><div itemprop=articleBody><ul></ul></div></main>",
    4: "<p>no root</p>", 5: "<article></article>all", 6: "<article><p></p></article><i>x</i>", 7: "<article><script>x</script></article>y", 8: "<nav><article>only chrome</article></nav>", 9: None,
    10: "<header itemprop=articleBody><b class='x katex'>f</b><a class=footnote-ref>1</a></header><details>d</details>",
}


def test_regions_are_told_in_one_pass(spark):
    pages = spark.createDataFrame(list(REGIONS.items()), "page_id long, html string")
    nodes = P.page_nodes(pages, only=("node", "last", "tag", "attrs", "text"))
    assert nodes.columns == ["page_id", "node", "last", "tag", "attrs", "text"]
    rows = C.region_stats(nodes, {"first": (True, None), "second": (False, F.col("tag").isin(*C.CHROME))})
    named = lambda r: ({k: v for k, v in zip(C.UNITS, r["units"]) if v}, r["chars"])
    assert {r["page_id"]: (r["rule"], named(r["first"]), named(r["second"])) for r in rows.collect()} == {
        1: ("article", ({"picture": 1, "image": 1, "link": 1, "heading": 1}, len("Askipp b")), ({"picture": 1, "image": 2, "heading": 1}, len("Ap b tail"))),
        2: ("article", ({"image": 1, "math": 2}, 11), ({"picture": 1, "math": 1}, len("rest z"))),
        3: ("main", ({"list": 1}, 0), ({"list": 1}, 6)),
        6: ("article", ({}, 0), ({}, 1)),
        10: ("articleBody", ({"math": 1, "noteref": 1}, 2), ({"details": 1}, 1)),
    }
    everything = P.page_nodes(pages)
    assert {r["page_id"]: named(r) for r in C.content_stats(C.article_nodes(everything)).collect()}[2] == ({"image": 1, "math": 2}, 11)
    assert sorted(map(tuple, nodes.drop("attrs").collect())) == sorted(map(tuple, everything.select("page_id", "node", "last", "tag", "text").collect()))


@pytest.mark.parametrize("name", ["article_choices", "page_content_stats"])
def test_pages_are_parsed_once_and_kept_never(spark, monkeypatch, name):
    from papershed.plans import node_queries as Q

    monkeypatch.setattr(P, "kept_nodes", lambda *a: pytest.fail("kept"))
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == plan.count("REPARTITION_BY_NUM") == 1 and plan.count("hashpartitioning(page_id") == 2 and plan.count("regexp_replace(array_join") == 2


def test_formulas(spark):
    given = {r"\(a\) \[b\] $$c$$": 3, r"\\(a\)": 0, r"\(a \(b\)": 1, r"\begin{align}x\end{align} \begin{align}x\end{gather}": 1, "$$a": 0, "": 0}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r[0] for r in df.select(C.math_count(F.col("t"))).collect()] == list(given.values())


def test_outline(pages):
    heads = [(r["nth"], r["level"], r["content"], r["anchor"]) for r in C.outline(P.page_nodes(pages)).orderBy("page_id", "nth").collect()]
    assert heads == [(1, 2, "Next #", "next"), (2, 2, "Related posts", "related-posts")]


def test_representations(pages):
    found = {r["page_id"]: r for r in C.representations(C.flow_texts(C.article_nodes(P.page_nodes(pages)))).collect()}
    assert found[1]["markdown"].split("\n\n")[:7] == ["## A story", "One bold word.", r"Two lines \<b\>", "- x", "- y", "- z", r"## Next #"]
    assert found[1]["plain"].split("\n\n")[0] == "A story" and found[1]["identity"].startswith("sha256:")
    assert C.representations(C.flow_texts(P.page_nodes(pages)), 5).filter("markdown is not null").count() == 0


def test_json_ld(spark):
    blocks = ['{"@type": "Thing", "name": "a"}', '[{"@type": ["X", "Article"], "headline": "b"}, {"@type": "Y"}]', '{"@graph": [{"@type": "Report", "headline": "c", "datePublished": "2024"}]}', "no json"]
    df = spark.createDataFrame([(blocks,)], "b array<string>")
    found = df.select(C.json_ld_nodes(F.col("b"))).first()[0]
    assert [(n["types"], n["headline"]) for n in found if n["types"] != [""]] == [(["Thing"], "a"), (["X", "Article"], "b"), (["Y"], None), (["Report"], "c")]


@pytest.mark.parametrize("raw, declared, want", [
    (b"\xef\xbb\xbfa\xc3\xa9", "latin1", ("aé", "utf-8", None)), ("é".encode("utf-16"), None, ("é", "utf-16-le", None)), (b"a\xe9", "iso-8859-1", ("aé", "cp1252", None)), (b"\x80", "latin1", ("€", "cp1252", None)),
    (b'<meta http-equiv=x content="text/html; charset=shift_jis">\x83\x65', None, ('<meta http-equiv=x content="text/html; charset=shift_jis">テ', "shift_jis", None)), (b"a\xe9", None, ("aé", "cp1252", "charset_guessed")),
    (b"ok", "no-such", ("ok", "utf-8", "charset_unsupported")), (b"a\xff", "utf-8", ("a\ufffd", "utf-8", "charset_replaced")), (b"", None, ("", "utf-8", None)), (None, None, (None, "", None)),
])
def test_charsets(raw, declared, want):
    assert P.decoded(raw, declared) == want
