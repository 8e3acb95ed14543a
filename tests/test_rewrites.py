"""Passes over page trees: the cases that each rule names, and order and logs of lists of passes."""

import pytest

from papershed.operators import pruning, rewrites
from papershed.operators.rewrites import Pass
from papershed.sources import pages as P
from papershed.sources.elements import grown

PAGE = "https://blog.example.org/post/"


def rewritten(html, passes=rewrites.PREEXTRACTION, source=PAGE):
    page = grown(P.tree(html))
    return page, rewrites.run(page, source, passes)


def pruned(html, source="", **known):
    page, rules = rewritten(html, pruning.passes(**known), source)
    return page.html(), [r.removeprefix("article.prune.").removesuffix("@1") for r in rules]


def unchanged(html, passes=rewrites.PREEXTRACTION):
    page, rules = rewritten(html, passes)
    assert rules == [] and page.html() == grown(P.tree(html)).html()


def icon(name, names="material-icons"):
    return f'<span class="{names}" aria-hidden="true">{name}</span>'


def test_icons_in_cells():
    cells = "".join(f"<td>{icon(n)}</td>" for n in rewrites.GLYPHS)
    page, rules = rewritten(f"<table><tr><th>{icon('check', 'material-symbols-rounded x')}</th>{cells}</tr></table>")
    assert rules == ["article.preextract.icon-cells@1"] and page.text() == "✓✓✓✓✗✗✗✗–"
    unchanged(f"<table><tr><td>{icon('info')}</td><td>{icon('check', 'other')}</td></tr></table><p>{icon('check')}</p>")


def test_classes_that_hide_boxes_before_and_after():
    page, rules = rewritten('<div class="a before:block l:before:hidden">x</div><p class="after:hover:invisible b file:hidden">y</p><i class="marker:hidden">z</i>')
    assert rules == ["article.preextract.pseudo-element-classes@1"]
    assert page.html() == '<div class="a before:block">x</div><p class="b">y</p><i>z</i>'
    unchanged('<p class="hidden sm:hidden first:hidden hover:invisible">x</p>')


def test_places_of_interactive_content():
    page, rules = rewritten('<d-figure id="fig"></d-figure><p>See <iframe class="sp-preview-iframe"></iframe></p><iframe title="Chart"></iframe><d-figure><img src="a"></d-figure>', source=f"{PAGE}#top")
    assert rules == ["article.preextract.interactive-placeholders@1"]
    assert page.html().startswith(f'<p><a href="{PAGE}#fig">Interactive figure — open in the original</a></p><p>See <a href="{PAGE}">Code playground — open in the original</a></p><iframe')
    assert rewritten("<d-figure></d-figure>", source="")[1] == []


def test_objects_that_are_pictures():
    page, rules = rewritten('<object type="Image/PNG; q=1" data="a/b.png" id="g" width="400" style="x">Loss <b>curve</b></object><object type="image/svg+xml" data="/c.svg" title="T"><object type="image/png" data="d.png"></object></object>')
    assert rules == ["article.preextract.image-objects@1"]
    assert page.html() == f'<img src="{PAGE}a/b.png" alt="Loss curve" id="g" width="400"><img src="https://blog.example.org/c.svg" alt="T" title="T">'
    unchanged('<object type="application/pdf" data="/p.pdf"></object><object type="image/png"></object><object type="image/png" data="data:x"></object><object type="image/png" data="/p.png" height="1"></object><object data="/f.svg"></object>')


def test_callouts_become_quotes():
    prose = "The team looks into whether code can be made faster by itself, and it could change soon."
    page, rules = rewritten(
        f'<aside class="note">Tools cannot measure this.</aside><div class="callout callout-warning"><span class="sr-only">Warning</span><p>Measure it.</p></div>'
        f'<aside id="memo">{prose}<div class="note">Nested.</div></aside><div class="admonition"><p>Read.</p></div><section class="key-point">One.</section>'
    )
    assert rules == ["article.preextract.callouts@1"]
    assert page.html() == (
        f'<blockquote data-callout="note">Tools cannot measure this.</blockquote><blockquote data-callout="warning"><p>Measure it.</p></blockquote>'
        f'<blockquote data-callout="note" id="memo">{prose}<div class="note">Nested.</div></blockquote><blockquote data-callout="note"><p>Read.</p></blockquote><blockquote data-callout="key-point">One.</blockquote>'
    )
    unchanged(
        f'<p>{prose}</p><aside class="x"><p>{prose}</p></aside><aside class="hide-on-print">{prose} Again.</aside><aside class="post pullquote">{prose} More.</aside><aside class="widget">{prose} 1</aside>'
        f'<aside><a href="/a">{prose}</a> 2</aside><aside>Short.</aside><aside class="note" hidden>x</aside><nav><aside class="note">x</aside></nav><div class="note"><h1>All</h1></div><span class="note">x</span>'
        f'<div class="note">{"long " * 600}</div><noscript><div class="admonition">x</div></noscript>'
    )


def test_headings_inside_their_permalink():
    page, rules = rewritten('<a id="s" href="#s"><h2>Simple</h2></a><a href="#p"> <h3 id="p">Parting</h3> </a>')
    assert rules == ["article.preextract.anchor-headings@1"] and page.html() == '<h2 id="s">Simple</h2><h3 id="p">Parting</h3>'
    unchanged('<nav><a href="#t"><h2>Contents</h2></a></nav><a href="#m">Read: <h4>Next</h4></a><a href="/e"><h3>Else</h3></a>')


def test_runs_of_footnotes():
    note = lambda k: f'<div class="footnote" data-component-name="FootnoteToDOM"><a class="footnote-number" id="n{k}" href="#a{k}">{k}</a><div class="footnote-content"><p>Note {k}</p></div></div>'
    page, rules = rewritten(f"<p>End.</p>{note(1)}\n{note(2)}<div class=footnote>Other</div>")
    assert rules == ["article.preextract.substack-footnotes@1"]
    assert page.html() == '<p>End.</p><section class="footnotes"><ol><li id="n1"><p>Note 1</p></li><li id="n2"><p>Note 2</p></li></ol></section><div class="footnote">Other</div>'
    unchanged('<div class="footnote" data-component-name="FootnoteToDOM"><p>No number</p></div>')


def test_marks_of_footnotes():
    page, rules = rewritten('<p>a<a href="#f1" class="footnoteRef x" id="r1"><sup>1</sup></a> b<sup class="footnote-ref"><a href="#f2">[2]</a></sup> c<a href="#f3" rel="footnote3">3</a></p><ol><li id="f1">1<li id="f2">2<li id="f3">3</ol>')
    assert rules == ["article.preextract.footnote-references@1"]
    marks = page.all("a", where=lambda a: "data-footnote-ref" in a.attrs)
    assert [(a.up.tag, a.up.text(), a.get("class")) for a in marks] == [("sup", "1", "x"), ("sup", "[2]", ""), ("sup", "3", "")]
    assert not page.all("sup", where=lambda n: n.up.inside("sup"))
    unchanged('<p><a class="footnote-ref" href="#gone">1</a><a href="#f1" rel="footnote-backref">back</a><a class="footnote-ref" href="/else#f1">1</a></p><p id="f1">x</p>')


def body(n, text="Substantive paragraph on the matter at hand. "):
    return f"<p>{text * n}</p>"


def test_contents_go_and_other_lists_stay():
    links = '<ul><li><a href="#a">A</a></li><li><a href="#b">B</a></li></ul>'
    html, rules = pruned(f'<h2>Table of Contents</h2>{links}<h2 id="a">A</h2>{body(10)}')
    assert rules == ["table-of-contents"] and html == f'<h2 id="a">A</h2>{body(10)}'
    assert pruned(f'<h2>Contents</h2><ul><li><a href="https://a.org/x">X</a></li><li><a href="https://a.org/y">Y</a></li></ul>{body(10)}')[1] == []
    assert pruned(f'{body(9)}<div class="toc">{links}</div>{body(9)}')[1] == ["table-of-contents"]
    html, rules = pruned(f"{body(4)}{links}<p>正在加载…</p>{body(9)}")
    assert rules == ["navigation-lists"] and html == body(4) + body(9)
    on_page = links.replace('"#', '"https://x.org/p#')
    assert pruned(body(4) + on_page + body(9), "https://x.org/p")[1] == ["navigation-lists"]
    assert pruned(body(4) + on_page + body(9), "https://x.org/other")[1] == []
    cited = "".join(f'<li>A long point of its own that cites a note in the end <sup><a href="#fn{k}">[{k}]</a></sup></li>' for k in range(3))
    assert pruned(f"{body(4)}<ul>{cited}</ul>{body(9)}")[1] == []
    partly = "".join(f'<li><a href="#p{k}">Linked words here</a></li>' for k in range(3)) + "<li>and a good deal of text that is no link at all</li>"
    assert pruned(f"{body(4)}<ul>{partly}</ul>{body(9)}")[1] == []


def test_sections_of_chrome_at_the_end():
    html, rules = pruned(f'{body(10)}<h2>Discussion</h2>{body(10)}<h2>Results</h2>{body(10)}<h2>Related posts</h2><ul><li><a href="/o">O</a></li></ul><h2>Share</h2><p>Tweet this</p>')
    assert rules == ["trailing-chrome"] * 2 and html.endswith(f"<h2>Results</h2>{body(10)}") and "Discussion" in html
    html, _ = pruned(f"{body(20)}<h3>Related</h3><p>links</p><h4>Sub</h4><p>more</p><h2>Appendix</h2><p>Real appendix.</p>")
    assert html.endswith("<h2>Appendix</h2><p>Real appendix.</p>") and "links" not in html and "<h4>" not in html
    assert pruned(f"{body(40)}<h2>Written by hand</h2>{body(20)}")[1] == []  # long prose is the author's
    assert pruned(f"{body(40)}<h2>Comments</h2>{body(20)}")[1] == ["trailing-chrome"]
    assert "Knuth" in pruned(f'{body(20)}<h2>Sponsors</h2><div class="references"><ol><li>Knuth, 1968.</li></ol></div>')[0]
    assert pruned(f"{body(2)}<h2>Related</h2><p>x</p>{body(30)}")[1] == []  # too early
    assert pruned(f"{body(20)}<h2>Further reading</h2><p>Here is a list of papers that matter, by hand.</p>")[1] == []


def test_cards_and_promotions_at_the_end():
    cards = '<div class="bio"><a href="/a"><img src="i.png"></a><p>Written by Jane Doe.</p></div>'
    html, rules = pruned(f'{body(20)}<h2>References</h2><ol><li><a href="https://a.org">Paper A</a></li><li><a href="https://b.org">Paper B</a></li></ol>{cards}')
    assert rules == ["trailing-cards"] and html.endswith("</ol>")
    half = "<p>" + "Subscribe now and then. " * 20 + "</p>"
    assert pruned(body(5) + half * 2)[1] == []  # more than two fifths isn't trimmed
    assert pruned(f"{body(20)}<p>[20] AutoGPT. <a href='https://g.org'>https://g.org/a/very/long/link/of/a/reference</a></p>")[1] == []
    assert pruned(f"{body(20)}<p>software:</p><ul><li><a href='https://g.org'>ignite</a> lets you take an image and run it as a machine</li></ul>")[1] == []
    html, rules = pruned(f'{body(20)}<h3>More</h3><p>Here is another for you:</p><ul><li><a href="/1">One</a> May 2024</li><li><a href="/2">Two</a></li></ul>')
    assert rules == ["trailing-cards"] and html == body(20)
    assert pruned(f"{body(9)}<p>Posted on 5 May 2024</p>")[0] == body(9)


def test_lines_before_the_article():
    html, rules = pruned(f'<article><p class="meta">30 May 2007 — 3 min read — Comments</p>{body(12)}<footer><a href="mailto:x">mail</a><a href="https://t.co">t</a></footer></article>')
    assert rules == ["trailing-cards", "leading-meta"] and html == f"<article>{body(12)}</article>"
    html, rules = pruned(f"<p>By Ann Bee</p><p>作者： Ann Bee</p><p>日期： 2019年9月5日</p>{body(8)}", byline="Ann Bee")
    assert rules == ["leading-meta"] and html == body(8)
    assert pruned(f"<p>In 2019 the town had a fair that everyone still remembers.</p>{body(8)}")[1] == []
    assert pruned(f"<div>Contents</div><p></p><ul><li><a href='#a'>A</a></li><li><a href='#b'>B</a></li></ul>{body(8)}")[0] == body(8)


def test_titles_and_headings():
    html, rules = pruned(f'<p>June 1, 2023</p><h1>My way</h1>{body(5)}<h1 id="i">Interlude</h1>{body(5)}', title="My Way ")
    assert rules == ["duplicate-title", "demote-h1", "leading-meta"] and html == f'{body(5)}<h2 id="i">Interlude</h2>{body(5)}'
    assert pruned(f"<h1>Ann's Notebook</h1>{body(8)}", title="Else", sites=["ann's notebook"])[1] == ["site-heading"]
    late = f"<h2>Inside the frontier</h2>{body(6)}<h2>Outside</h2>{body(6)}<h2>Centaurs</h2>{body(6)}"
    assert pruned(late, title="Centaurs on the frontier")[1] == []
    html, rules = pruned(f'<h2>Attention<a class="anchor" href="#x">#</a></h2><h3><a href="#g">Garden</a></h3><h2><img src="l.png">Basics</h2><h3 id="pure"><a href="#pure">Jump here</a>Pure</h3><h3 id="io"><a href="#io-x">io</a> opt</h3>{body(5)}')
    assert rules == ["heading-anchors"]
    assert html.startswith('<h2>Attention</h2><h3>Garden</h3><h2>Basics</h2><h3 id="pure">Pure</h3><h3 id="io"><a href="#io-x">io</a> opt</h3>')


def test_markup_of_old_pages():
    essay = f"<table><tr><td><font size=2>July<br><br>{'Great work. ' * 40}</font></td></tr></table>"
    html, rules = pruned(essay + body(3) + "<table><tr><td>A</td></tr></table>")
    assert rules == ["unwrap-font", "layout-table"] and html.startswith("<div>July<br><br>Great") and html.endswith("<table><tr><td>A</td></tr></table>") or "July" in html
    html, rules = pruned(f'{body(6)}<blockquote><pre>x = 1</pre></blockquote><blockquote><p>Said.</p></blockquote><section class="footnotes"><ol><li id="f"><p>Note.</p><p><a href="#fnref-1">↩</a></p></li></ol></section>')
    assert rules == ["code-blockquote", "footnote-backrefs"] and "<blockquote><pre>" not in html and "<blockquote><p>Said.</p></blockquote>" in html and "↩" not in html and "<p>Note.</p></li>" in html
    html, rules = pruned(f'{body(6)}<p><a name="t">There</a> it is.</p>{body(6)}')
    assert rules == ["anchor-targets"] and '<span id="t">There</span>' in html


def test_passes_run_in_their_order_and_callers_add_their_own(spark):
    shout = Pass("mine.shout@1", lambda page, source: [setattr(n, "data", n.data.upper()) for n in page.every() if n.data] and 1)
    rows = [(1, PAGE, "<table><td>" + icon("check") + "</table><a href='#x'><h2>Hi</h2></a>", "T"), (2, PAGE, None, None), (3, None, "<div>" * 600 + "deep", "T"), (4, PAGE, "plain", "T")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, title string")
    found = P.rewritten_nodes(pages, lambda row: (*rewrites.PREEXTRACTION, shout) if row["title"] else (), context=("title",))
    by = {r["page_id"]: r["rules"] for r in found.filter("rules is not null").collect()}
    assert by == {1: ["article.preextract.icon-cells@1", "article.preextract.anchor-headings@1", "mine.shout@1"], 3: ["unchanged.too-large"], 4: ["mine.shout@1"]}
    texts = {r["page_id"]: r["content"] for r in P.texts(found, ["page_id"]).collect()}
    assert texts == {1: "✓HI", 3: "deep", 4: "PLAIN"}


def test_trees_come_back_as_rows():
    html = "<p>a<br>b<ul><li>x<li>y</ul><img src=q>z<script>1<2</script>"
    assert P.regrown(grown(P.tree(html))) == P.tree(html)


@pytest.mark.parametrize("html", ["", "<p>a</p><![ x", '<!["', "</", "<a <b", "<p =x=1 ==>t", "<title>a &amp; <b></title>x", "<textarea>", "&#x110000;&#0;"])
def test_no_page_ends_the_job(html):
    rows = P.tree(html)
    assert P.regrown(grown(rows)) == rows
    for passes in (rewrites.PREEXTRACTION, pruning.passes("t", ["site"], "by")):
        rewritten(html, passes)
