"""Reader documents: what pages become, each rule of the grammar broken and kept, and Markdown."""

import pytest
from pyspark.sql import functions as F

from papershed.operators import reader as R

SOURCE = "https://blog.example.org/post/"


def shape(n):
    """A document as nested tuples: kind, value or properties that matter, children."""
    kids = [shape(k) if not r else (r, shape(k)) for r, k in n.kids]
    own = [v for k, v in n.props.items() if k in ("depth", "anchor", "callout", "identifier", "lang", "start", "targetAnchor")]
    return (n.kind, *([n.value] if n.value is not None and not kids else []), *own, *kids)


def doc(html, title=""):
    made = R.reader_document(html, SOURCE, title)
    return [shape(k) for _, k in made.kids], [(c, t) for c, _, t in made.losses]


def test_blocks():
    made, losses = doc('<h2 id="a">One <b>two</b></h2><p>x <i>y</i><br>z</p>loose <section id=s><p>in</p></section><hr><blockquote data-callout="Tip"><p>t</p></blockquote><blockquote data-callout="odd">u</blockquote>')
    assert made == [
        ("heading", "2", "a", ("text", "One "), ("strong", ("text", "two"))), ("paragraph", ("text", "x "), ("emphasis", ("text", "y")), ("break",), ("text", "z")), ("paragraph", ("text", "loose")),
        ("section", "s", ("paragraph", ("text", "in"))), ("thematicBreak",), ("blockquote", "tip", ("paragraph", ("text", "t"))), ("blockquote", "note", ("paragraph", ("text", "u"))),
    ]
    assert losses == []


def test_lists_nest():
    made, _ = doc('<ol start=3><li>a<ul><li>b</li></ul></li><li><p>c</p><p>d</p></li></ol>')
    assert made == [("list", "3", ("listItem", ("paragraph", ("text", "a")), ("list", ("listItem", ("paragraph", ("text", "b"))))), ("listItem", ("paragraph", ("text", "c")), ("paragraph", ("text", "d"))))]


def test_breaks_part_paragraphs():
    made, _ = doc("<p>one<br> <br>two<br>three<br><br><br></p><p>&nbsp;<br></p><p><br>four</p>")
    assert made == [("paragraph", ("text", "one")), ("paragraph", ("text", "two"), ("break",), ("text", "three")), ("paragraph", ("text", "four"))]


def test_code_and_formulas():
    made, _ = doc('<pre><code class="language-py">x = 1\n  y\n</code></pre><code>a\nb</code><p>in <code>c`d</code> \\(x^2\\) costs $5 or $6, $y_1$.</p><p>$$z$$</p><div>\\[a\\]\\begin{align}b\\end{align}</div>')
    assert made == [
        ("code", "x = 1\n  y", "py"), ("code", "a\nb"),
        ("paragraph", ("text", "in "), ("inlineCode", "c`d"), ("text", " "), ("math", "x^2"), ("text", " costs $5 or $6, "), ("math", "y_1"), ("text", ".")),
        ("math", "z"), ("math", "a"), ("math", r"\begin{align}b\end{align}"),
    ]


def test_links_pictures_and_what_is_lost():
    made, losses = doc(
        '<p><a href="/a?b=ä" title=T>in <a href="javascript:x">bad</a></a> <a href="mailto:a@b.c">m</a> <a href="https://u:p@h/x">user</a> <a href="#place">p</a></p>'
        '<p><img src="i.png" alt=A width=30 height=0><img src="data:image/png;base64,AAAA"><img src="data:image/svg+xml;base64,AAAA" alt=S></p><iframe src=x></iframe><p>a<video></video><blink>b</blink></p>'
    )
    assert losses == [("NESTED_LINK_FLATTENED", "a"), ("UNSAFE_LINK_DROPPED", "a"), ("UNSAFE_IMAGE_DROPPED", "img"), ("ACTIVE_CONTENT_DROPPED", "iframe"), ("ACTIVE_CONTENT_DROPPED", "video"), ("UNSUPPORTED_ELEMENT", "blink")]
    root = R.reader_document('<p><a href="/a?b=ä" title=T>in</a><a href="#place">p</a></p><p><img src="i.png" alt=A width=30 height=0></p>', SOURCE)
    links = [k for _, p in root.kids for _, k in p.kids if k.kind == "link"]
    assert [k.props for k in links] == [{"url": "https://blog.example.org/a?b=%C3%A4", "title": "T"}, {"url": f"{SOURCE}#place", "targetAnchor": "place"}]
    picture = root.kids[1][1]
    assert picture.kind == "figure" and picture.part("media")[0].props == {"url": f"{SOURCE}i.png", "width": "30"} and picture.part("media")[0].value == "A"
    flat = R.Builder(SOURCE)
    nested = flat.flow(R.grown([[0, 3, None, 0, "a", [("href", "/a")], None, 0], [1, 3, 0, 1, "i", [], None, 0], [2, 3, 1, 2, "a", [("href", "/b")], None, 0], [3, 3, 2, 3, "#text", [], "x", 0]]).kids)
    assert [c for c, _, _ in flat.losses] == ["NESTED_LINK_FLATTENED"] and shape(nested[0]) == ("paragraph", ("link", ("emphasis", ("text", "x"))))


def test_tables_and_figures():
    made, losses = doc('<table><caption>C</caption><thead><tr><th scope=col>H<td colspan=2 align=Right>I<tbody><tr><td><ul><li>x</ul><tr><td rowspan=9999>y<tfoot><tr><td>f</table><table></table>')
    cell = lambda *kids: ("tableCell", *kids)
    text = lambda t: ("paragraph", ("text", t))
    assert made == [(
        "table", ("caption", ("text", "C")), ("head", ("tableSection", ("tableRow", cell(text("H")), cell(text("I"))))),
        ("body", ("tableSection", ("tableRow", cell(("list", ("listItem", text("x"))))), ("tableRow", cell(text("y"))))), ("foot", ("tableSection", ("tableRow", cell(text("f"))))),
    )]
    assert losses == [("EMPTY_TABLE_FLATTENED", "table")]
    made, losses = doc('<figure><img src=a.png><figcaption>Seen <small>by Ann</small></figcaption></figure><figure><pre>x</pre><figcaption>No picture</figcaption></figure>')
    assert made == [("figure", ("media", ("image", "")), ("caption", ("text", "Seen")), ("credit", ("text", "by Ann"))), ("code", "x"), ("paragraph", ("text", "No picture"))]
    assert losses == [("FIGURE_WITHOUT_MEDIA_FLATTENED", "figure")]


def test_notes():
    made, _ = doc('<p>a<sup><a href="#fn1">1</a></sup> <sup>2</sup> <a href="#fn2" data-footnote-ref>*</a></p><section class=footnotes><ol><li id=fn1>One <a role=doc-backlink href="#r">b</a></li><li id="user-content-fn2">Two</li><li id=fn1>Again</li><li>None</li></ol></section>')
    assert made[0] == ("paragraph", ("text", "a"), ("footnoteReference", "1", "fn1"), ("text", " "), ("superscript", ("text", "2")), ("text", " "), ("footnoteReference", "*", "fn2"))
    assert made[1:] == [("footnoteDefinition", "fn1", ("paragraph", ("text", "One"))), ("footnoteDefinition", "fn2", ("paragraph", ("text", "Two")))]


def test_titles_and_budgets():
    assert doc("<h1>My Way!</h1><p>x</p>", "my way") == ([("paragraph", ("text", "x"))], [("DUPLICATE_TITLE_REMOVED", "h1")])
    assert doc("<div>" * 200 + "x") == ([], [("SOURCE_REPRESENTATION_BUDGET_EXCEEDED", "html")])
    assert doc(None) == doc("") == ([], [])
    assert doc("<html><head><title>t</title><style>p{}</style></head><body><p>x") == ([("paragraph", ("text", "x"))], [])


def test_markdown():
    html = (
        '<h2>A *star*</h2><p>b <b>bold </b>and <i>it</i> <a href="/l">li[n]k</a> <code>c`d</code><br>next</p><ul><li>x<ol><li>y</li></ol></li><li><p>p</p><pre>z</pre></li></ul><blockquote data-callout=tip><p>t</p></blockquote>'
        '<table><tr><th>H</th><th>I|J</th></tr><tr><td>1</td></tr></table><p>n<sup><a href="#fn1">1</a></sup></p><section class=footnotes><ol><li id=fn1><p>One</p><p>Two</p></li></ol></section><p>$$z$$</p><figure><img src=a.png alt=A><figcaption>Seen</figcaption></figure>'
    )
    root = R.reader_document(html, SOURCE)
    assert R.flow_markdown([k for _, k in root.kids]) == (
        "## A \\*star\\*\n\nb **bold** and *it* [li\\[n\\]k](https://blog.example.org/l) ``c`d``\\\nnext\n\n- x\n\n  1. y\n- p\n\n  ```\n  z\n  ```\n\n> [!TIP]\n> t\n\n"
        "| H | I\\|J |\n| --- | --- |\n| 1 |  |\n\nn[^fn1]\n\n[^fn1]: One\n\n    Two\n\n$$\nz\n$$\n\n![A](https://blog.example.org/post/a.png)\n\nSeen"
    )


@pytest.fixture(scope="module")
def nodes(spark):
    html = (
        '<h1 id=t>T</h1><p>a <a href="/x">b</a> <img src="i.png" alt=A width=9> \\(m\\)<sup><a href="#fn1">1</a></sup></p><figure><img src=f.png><figcaption>C</figcaption></figure><ul><li>x</li></ul>'
        '<table><tr><td colspan=2>1</td></tr></table><blockquote data-callout=note>q</blockquote><section class=footnotes><ol><li id=fn1>n</li><li id=fn2>m</li></ol></section><p>$$d$$</p><iframe></iframe>'
    )
    pages = spark.createDataFrame([(1, SOURCE, html), (2, SOURCE, None)], "page_id long, url string, html string")
    return R.reader_nodes(pages).cache()


def test_a_document_that_follows_the_grammar(nodes):
    assert R.violations(nodes).count() == 0
    assert nodes.filter("page_id = 2").count() == 1 and nodes.filter("page_id = 1 and node = 0").first()["losses"][0]["code"] == "ACTIVE_CONTENT_DROPPED"
    by = {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert by["image"] == 2 and by["footnoteDefinition"] == 2 and by["tableCell"] == 1 and by["math"] == 2


def props(name, value):
    return f"map_concat(map_filter(props, (k, v) -> k <> '{name}'), map('{name}', '{value}'))"


BROKEN = {
    "unknown_kind": [("kind", "kind = 'link'", "'blink'")],
    "misplaced": [("kind", "kind = 'paragraph'", "'text'"), ("kind", "kind = 'list'", "'section'"), ("kind", "kind = 'image' and role = 'media'", "'text'"), ("kind", "kind = 'tableRow'", "'tableCell'"),
                  ("props", "kind = 'math' and props['display'] = 'true'", props("display", "false")), ("props", "kind = 'math' and props['display'] = 'false'", props("display", "true")), ("role", "role = 'caption'", "'media'")],
    "unsafe_url": [("props", "kind = 'link'", props("url", "javascript:x")), ("props", "kind = 'link'", props("url", "https://u:p@h/")), ("props", "kind = 'image'", props("url", "mailto:a@b")), ("props", "kind = 'image'", props("url", "data:image/svg+xml;base64,AA")), ("props", "kind = 'link'", "map_filter(props, (k, v) -> k <> 'url')")],
    "bad_value": [("props", "kind = 'heading'", props("depth", "7")), ("props", "kind = 'heading'", "map_filter(props, (k, v) -> k <> 'depth')"), ("props", "kind = 'image'", props("width", "0")), ("props", "kind = 'tableCell'", props("colSpan", "1001")), ("props", "kind = 'tableCell'", props("align", "justify")),
                  ("props", "kind = 'blockquote'", props("callout", "shout")), ("props", "kind = 'list'", props("ordered", "maybe"))],
    "empty_math": [("value", "kind = 'math'", "''")],
    "no_identifier": [("props", "kind = 'footnoteReference'", props("identifier", "")), ("props", "kind = 'footnoteDefinition'", "map_filter(props, (k, v) -> k <> 'identifier')")],
    "duplicate_footnote": [("props", "kind = 'footnoteDefinition'", props("identifier", "fn1"))],
    "bad_loss": [("losses", "kind = 'root'", "transform(losses, x -> named_struct('code', x.code, 'fallback', 'gone', 'tag', x.tag))")],
}


@pytest.mark.parametrize("rule, column, where, value", [(r, *c) for r, cases in BROKEN.items() for c in cases])
def test_each_rule_is_told(nodes, rule, column, where, value):
    damaged = nodes.filter("page_id = 1").withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))
    assert rule in {r["rule"] for r in R.violations(damaged).collect()}


def test_rules_on_what_is_missing(nodes):
    assert {r["rule"] for r in R.violations(nodes.filter("not (role = 'media' or kind = 'tableSection')")).collect()} >= {"empty_figure", "empty_table"}
    link = nodes.filter("page_id = 1").withColumn("kind", F.when((F.col("kind") == "text") & (F.col("value") == "b"), "link").otherwise(F.col("kind")))
    assert "nested_link" in {r["rule"] for r in R.violations(link.withColumn("props", F.when(F.col("kind") == "link", F.expr(props("url", "https://a.b/"))).otherwise(F.col("props")))).collect()}


def test_limits(nodes):
    n = nodes.filter("page_id = 1").count()
    fits = lambda **kw: {r["page_id"]: r["fits"] for r in R.within_limits(nodes, **kw).collect()}
    assert fits() == {1: True, 2: True} and fits(most_nodes=n - 1) == fits(deepest=3) == fits(most_bytes=20) == {1: False, 2: True}


def test_only_the_wanted_columns_are_made_and_nothing_is_dealt(spark, monkeypatch):
    from papershed.plans import reader_queries as Q

    monkeypatch.setattr(R, "flow_markdown", lambda *a: pytest.fail("unwanted markdown"))
    assert R.document_rows(R.reader_document("<p>a</p>", "http://a.org/"), markdown=False)[0][9] is None
    pages = spark.createDataFrame([(k, "http://a.org/", f"<h1>{k}</h1><p>a <b>b</b></p>" if k else None) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    some = R.reader_nodes(pages, only=("kind", "node"))
    assert some.columns == ["page_id", "node", "kind"]
    assert sorted(map(tuple, some.collect())) == sorted((r["page_id"], r["node"], r["kind"]) for r in R.reader_nodes(pages, only=("node", "kind", "value", "props")).collect())
    monkeypatch.setattr(Q, "kept", lambda *a: pytest.fail("kept"))
    assert Q.reader_documents(spark, "/root/testdata/sf0.001").count() == Q.reader_limits(spark, "/root/testdata/sf0.001").count() > 0
