import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papershed.llm import html_extract as H
from papershed.llm.queries import op9_html_text

TEXT = "<p>First words of the story are here.</p><p>Second\n  part &amp; more&nbsp;words, <b>bold</b>ly.</p>"
WANT = "First words of the story are here.\nSecond part & more words, boldly."
PAGES = {
    "article": f"<html><head><title>no</title></head><body><nav><a>Home</a></nav><article>{TEXT}</article><footer>&copy; x</footer></body></html>",
    "noise inside": f"<body><article>{TEXT}<div class='share-bar'>Share</div><aside>Side</aside><form><input>Mail</form></article></body>",
    "plain": f"<body><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul><div id=content>{TEXT}</div><div class=comments><p>Nice post!</p></div></body>",
    "scripts": f"<body><script>var t='</p>';if(a<b)x()</script><style>p{{}}</style><!-- <p>no</p> --><main>{TEXT}</main><div class='cookie-notice'>Accept</div></body>",
    "open tags": "<article><p>First words of the story are here.<p>Second part &#38; more words, <b>boldly.</article><footer>end</footer>",
}


@pytest.mark.parametrize("name", PAGES)
def test_regions(name):
    assert H.Weights().extract(PAGES[name]) == WANT


MENU = "<nav><a href=/>Home</a></nav>"
#: Pages whose wrapping elements have names that speak of sidebars, comments or headers.
WRAPPED = {
    "with sidebar": f"<body>{MENU}<div class='content-with-sidebar'>{TEXT}</div><div class=sidebar>Side</div></body>",
    "no sidebar": f"<body>{MENU}<div class='post no-sidebar'>{TEXT}</div></body>",
    "has comments": f"<body>{MENU}<div id=page class='has-comments'><h1>A first title</h1>{TEXT}</div></body>",
    "data-id": f"<body>{MENU}<div data-id='share-3'>{TEXT}</div></body>",
    "post header": f"<body>{MENU}<article><h1 class='post-header'>A first title</h1>{TEXT}</article></body>",
    "header in article": f"<body>{MENU}<article><header class=header><h1>A first title</h1></header>{TEXT}</article></body>",
    "form around all": f"<body><form action=/>{MENU}<main>{TEXT}</main></form></body>",
    "banner around all": f"<body class=banner><div class=banner>{TEXT}</div></body>",
    "quotes in tags": f"<body>{MENU}<article title='a > b'><img alt=\"<p>no</p>\">{TEXT}</article></body>",
    "comment box in article": f"<body>{MENU}<article>{TEXT}<section id='reader-comments'><p>Nice!</p></section></article></body>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_no_article_is_lost_to_a_name(name):
    want = f"A first title\n{WANT}" if "<h1" in WRAPPED[name] else WANT
    assert H.Weights().extract(WRAPPED[name]) == want


COMMENT = "<article class='comment-body'><p>Nice post, I liked it a lot and I will come back for more of the same soon.</p></article>"
#: Reader comments and sidebars with elements of their own that otherwise hold main text, and articles parted by adverts.
PARTED = {
    "comments with articles": f"<body>{MENU}<article>{TEXT}</article><div id='comments' class='comments-area'>{COMMENT * 9}</div></body>",
    "comments with a title": f"<body>{MENU}<article>{TEXT}</article><section id='comments'><h1>Comments</h1><p>Nice post.</p></section></body>",
    "comments inside": f"<body>{MENU}<article>{TEXT}<section class='comments'>{COMMENT * 9}</section></article></body>",
    "comments in main": f"<body>{MENU}<main><article>{TEXT}</article><div class='comments'>{COMMENT}</div></main></body>",
    "loose comments": f"<body>{MENU}<article>{TEXT}</article><article class='comment'><p>Nice post.</p></article></body>",
    "sidebar with a title": f"<body>{MENU}<article>{TEXT}</article><div class='sidebar'><h1>About</h1><p>I write here about all that comes to my mind.</p></div></body>",
    "sidebar and plain text": f"<body>{MENU}<div id=content>{TEXT}</div><div class='sidebar'><h1>About</h1><p>Me.</p></div></body>",
    "article in a named element": f"<body>{MENU}<div class='widget'><article>{TEXT}</article></div></body>",
    "adverts before the end": f"<body>{MENU}<article>{TEXT}<div class=ad>Buy!</div><div class=ad>Buy!</div><div class=ad>Buy!</div><p>The end.</p></article></body>",
    "adverts in plain text": f"<body>{MENU}<div id=content>{TEXT}<div class=ad>Buy!</div><aside>x</aside><div class=ad>Buy!</div><p>The end.</p></div></body>",
}


@pytest.fixture(scope="module")
def fitted(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html"))


@pytest.mark.parametrize("name", PARTED)
def test_comments_go_and_ends_stay(fitted, name):
    want = WANT + "\nThe end." * ("The end." in PARTED[name])
    assert H.Weights().extract(PARTED[name]) == want
    assert fitted.extract(PARTED[name]) == want


def test_pages_with_comments_teach_as_well(spark):
    page = PARTED["comments with articles"]
    weights = H.fit(spark.createDataFrame([(k, page) for k in range(9)], "page_id long, html string"))
    assert weights.tags["nav"] < 0 and H.label(page)[0][""] == len(WANT.split()) and H.label("<main>x</main>") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "a ", "b c d ", "<br>", "<nav>x</nav>", "<ul>", "<li>", "</ul>"]), max_size=14))
def test_region_is_the_best_of_all_intervals(parts):
    """No interval of tokens scores higher than the blocks that were taken."""
    html, weights = "".join(parts), H.Weights(1.0, {"p": -0.5, "div": -1.5, "li": -2.0, "nav": -3.0}, -0.7)
    scores, words = [], []
    for kind, name, rest in H.without_apart(H.tokens(html)):
        if kind == "text":
            if rest.split():
                scores.append(float(len(rest.split())))
                words.append(rest.split())
        else:
            scores.append({"apart": H.REMOVED, "inner": 0.0}.get(kind, weights.tags.get(name, weights.other)))
            words.append([])
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    fits = [[w for part in words[i:j] for w in part] for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if abs(sum(scores[i:j]) - best) < 1e-9]
    got = weights.extract(html).split()
    assert not any(words) and not got or any(all(w in got for w in f) and len(f) <= len(got) for f in fits)


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<a '>\" ", "<a \">\"", "<!--", "<div class=a", "</p", "<p>", "<script>", "<", "x=\"", "<b id=\"", "<p>word ", "<div class=ad>", "&lt;"])
def test_time_is_linear(unit):
    import time

    began = time.process_time()
    H.Weights().extract(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 12


@pytest.mark.parametrize("html", [None, "", "   ", "<p></p>", "<nav>only a menu</nav>", "<"])
def test_pages_without_text(html):
    assert H.Weights().extract(html) in ("", "<")


def test_learned_weights(spark):
    pages = spark.createDataFrame([(k, PAGES["article"], "clash") for k in range(50)] + [(99, None, ""), (98, "", "")], "page_id long, html string, text string")
    weights = H.fit(pages)
    assert weights.word > 0 > max(weights.tags.values()) and weights.tags["nav"] < weights.tags["p"]
    assert weights.extract(PAGES["plain"]) == WANT
    assert H.fit(pages.limit(0)) == H.Weights()


def test_query_against_the_article_element(spark, sf_dir):
    import re
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op9_html_text(spark, sf_dir).collect()
    assert len(found) == len(html)
    for r in found:
        inside = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1], flags=re.S)
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
