"""What a page holds: statistics, article region, chrome, outline, pictures, embeds, footnotes, representations. All on page nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.urls import embed_kind, largest_in_srcset, resolved
from papershed.sources.pages import attr, inside, owned, texts, without

# Elements whose content no reader sees; the rich units in order; those that navigation is made of.
UNSEEN = ("script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas")
UNITS = ("pre", "figure", "picture", "image", "table", "math", "noteref", "endnotes", "link", "citation", "heading", "list", "details")
OF_NAVIGATION = (8, 10, 11)
MATH = UNITS.index("math")
ROOTS = ("article", "main", "articleBody")
KEPT_SHARE, MATH_SPAN = 0.6, 16 * 1024
FIRST_LEAST, FIRST_SHARE, SECOND_LEAST = 600, 0.5, 80
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CHROME = ("nav", "footer", "aside", "form", "header", "menu", "dialog")
MAX_IMAGES, MAX_EMBEDS, CONTEXT_CHARS = 80, 40, 160
LAZY = ("data-src", "data-original", "data-lazy-src")


def has_class(*names: str) -> Column:
    return F.when(attr("class").isNotNull(), F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(*[F.lit(n) for n in names]))).otherwise(False)


def math_count(text: Column) -> Column:
    r"""Formulas between \( \), \[ \], $$ $$ or in display environments, each at most 16 KiB long."""
    span = f"{{0,{MATH_SPAN}}}?"
    forms = (rf"(?s)(?<!\\)\\\(.{span}(?<!\\)\\\)", rf"(?s)(?<!\\)\\\[.{span}(?<!\\)\\\]", rf"(?s)(?<!\\)\$\$.{span}(?<!\\)\$\$", rf"(?s)(?<!\\)\\begin\{{((?:equation|align|gather|multline|flalign|alignat)\*?)\}}.{span}(?<!\\)\\end\{{\1\}}")
    total = F.lit(0)
    for form in forms:
        total = total + F.regexp_count(text, F.lit(form))
    return total


def content_stats(nodes: DataFrame) -> DataFrame:
    """``page_id, units`` (13 counts in the order of UNITS), ``chars``: of what readers see; text is counted with white space squeezed."""
    return region_stats(nodes, {"page": (False, None)}).select("page_id", "page.units", "page.chars")


def _units() -> tuple[Column, ...]:
    """Which of UNITS an element is; whether a picture holds an img is told by where it lies."""
    role, tag = attr("role"), F.col("tag")
    return (
        tag == "pre", tag == "figure", tag == "picture", tag == "img", tag == "table", (tag == "math") | has_class("math", "katex"),
        (role == "doc-noteref") | ((tag == "a") & (has_class("footnote-ref") | attr("data-footnote-ref").isNotNull())), (role == "doc-endnotes") | has_class("footnotes") | (attr("id") == "footnotes"),
        (tag == "a") & attr("href").isNotNull(), (tag == "cite") | role.isin("doc-bibliography", "doc-biblioentry") | has_class("bibliography", "references") | attr("id").isin("bibliography", "references"),
        tag.isin(*HEADINGS), tag.isin("ul", "ol", "dl"), tag == "details",
    )


def region_stats(nodes: DataFrame, regions: dict[str, tuple[bool, Column | None]]) -> DataFrame:
    """``page_id, rule`` (see ``article_roots``) and for each region struct<units, chars> (see ``content_stats``), for pages that have something to see in every region.

    A region is the page or (True) the inside of its article root, without the elements for which the condition holds. Nodes are
    cut down to what counts, then dealt and sorted once, whatever the number of regions.
    """
    tag, node, none = F.col("tag"), F.col("node"), F.lit(False)
    marks = reduce(Column.bitwiseOR, [F.when(unit, 1 << k).otherwise(0) for k, unit in enumerate(_units())])
    slim = nodes.select(
        "page_id", "node", "last", _root_kind().alias("kind"), F.coalesce(tag.isin(*UNSEEN, "head"), none).alias("unseen"), F.coalesce(tag == "picture", none).alias("picture"),
        *[F.coalesce(gone if gone is not None else none, none).alias(f"{name}_gone") for name, (_, gone) in regions.items()],
        F.when(tag == "#text", 0).otherwise(marks).alias("marks"), F.when(tag == "#text", F.col("text")).alias("text"),
    )
    before = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    roots = [F.when(F.count_if(F.col("kind") == k).over(whole) == 1, F.min(F.when(F.col("kind") == k, F.struct("kind", "node", "last"))).over(whole)) for k in range(len(ROOTS))]
    rooted = slim.withColumn("root", F.coalesce(*roots))
    placed, seen = [], []
    for name, (article, _) in regions.items():
        within = (node > F.col("root.node")) & (node <= F.col("root.last")) if article else F.lit(True)
        holds = lambda owner, w=within: F.coalesce(F.max(F.when(w & owner, F.col("last"))).over(before) >= node, none)
        gone = F.col("unseen") | F.col(f"{name}_gone")
        placed += [F.coalesce(within, none).alias(f"{name}_in"), gone.alias(f"{name}_out"), holds(gone).alias(f"{name}_hidden"), holds(F.col("picture")).alias(f"{name}_framed")]
        seen.append((F.col(f"{name}_in") & ~F.col(f"{name}_out") & ~F.col(f"{name}_hidden")).alias(name))
    shown = rooted.select("page_id", "node", "root", "marks", "text", *placed).select("page_id", "node", "root.kind", "marks", "text", *seen, *[f"{name}_framed" for name in regions]).filter(reduce(Column.__or__, [F.col(name) for name in regions]))
    sums = [F.max("kind").alias("kind"), F.collect_list(F.when(F.col("text").isNotNull(), F.struct("node", "text", *regions))).alias("texts")]
    for name in regions:
        counted = [F.col(name) & (F.col("marks").bitwiseAND(1 << k) != 0) & (~F.col(f"{name}_framed") if unit == "image" else F.lit(True)) for k, unit in enumerate(UNITS)]
        sums += [F.max(name).alias(f"{name}_any"), F.array(*[F.count_if(c).cast("int") for c in counted]).alias(f"{name}_units")]
    pages = shown.groupBy("page_id").agg(*sums).filter(reduce(Column.__and__, [F.col(f"{name}_any") for name in regions])).withColumn("texts", F.sort_array("texts"))
    joined = lambda name: F.array_join(F.transform(F.filter("texts", lambda t: t[name]), lambda t: t["text"]), "")
    squeezed = pages.select("*", *[F.trim(F.regexp_replace(joined(name), r"\s+", " ")).alias(f"{name}_text") for name in regions])
    stats = []
    for name in regions:
        units = [F.get(f"{name}_units", F.lit(k)) for k in range(len(UNITS))]
        units[MATH] = F.greatest(units[MATH], math_count(F.col(f"{name}_text")).cast("int"))
        stats.append(F.struct(F.array(*units).alias("units"), F.char_length(f"{name}_text").alias("chars")).alias(name))
    return squeezed.select("page_id", F.get(F.array(*[F.lit(r) for r in ROOTS]), F.col("kind")).alias("rule"), *stats)


def union_of_units(*candidates: Column) -> Column:
    """The largest count of each unit over the units of a page's candidates."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda m, n: F.greatest(m, n)), candidates)


def keeps_units(kept: Column, source: Column) -> Column:
    """Whether every kind of content of the source is kept to 60 percent, one at least; links, headings and lists don't count."""
    pairs = F.zip_with(F.transform(source, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), F.coalesce(kept, F.array().cast("array<int>")), lambda s, k: F.struct(s.alias("s"), k.alias("k")))  # no array is made anew for each kind
    n, i = (lambda p: p["s"]["n"]), (lambda p: p["s"]["i"])
    fine = lambda p: p["s"].isNull() | (n(p) == 0) | i(p).isin(*OF_NAVIGATION) | (F.coalesce(p["k"], F.lit(0)) >= F.greatest(F.lit(1), F.ceil(n(p) * KEPT_SHARE)))
    return F.forall(pairs, fine)


def chosen_candidate(first: Column, second: Column, source: Column) -> Column:
    """"first", "second" or null, by struct<units, chars> of two candidates and the source's units.

    The first has 600 characters and half of the second's text, the second 80 characters; both keep the source's content.
    """
    first_fine = (first["chars"] >= FIRST_LEAST) & keeps_units(first["units"], source) & (second.isNull() | (first["chars"] >= FIRST_SHARE * second["chars"]))
    return F.when(first_fine, "first").when((second["chars"] >= SECOND_LEAST) & keeps_units(second["units"], source), "second")


def _root_kind() -> Column:
    """The place in ROOTS of what an element may be the root of."""
    tag = F.col("tag")
    return F.when(tag == "article", 0).when(tag == "main", 1).when(attr("itemprop") == "articleBody", 2)


def article_roots(nodes: DataFrame) -> DataFrame:
    """``page_id, root, root_last, rule``: a page's only article element, else its only main, else its only articleBody."""
    found = nodes.withColumn("kind", _root_kind()).filter("kind is not null").groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.min("node").alias("root"), F.min("last").alias("root_last"))
    best = found.filter("n = 1").groupBy("page_id").agg(F.min(F.struct("kind", "root", "root_last")).alias("b"))
    return best.select("page_id", "b.root", "b.root_last", F.get(F.array(*[F.lit(r) for r in ROOTS]), F.col("b.kind")).alias("rule"))


def article_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes inside a page's article root; pages without one have none."""
    return nodes.join(article_roots(nodes), "page_id").filter((F.col("node") > F.col("root")) & (F.col("node") <= F.col("root_last"))).drop("root", "root_last", "rule")


def outline(nodes: DataFrame) -> DataFrame:
    """``page_id, nth, level, content, anchor``: headings 2 to 4 in order; anchors are slugs of the text, repeats numbered."""
    tag = F.col("tag")
    heads = texts(owned(nodes, tag.isin("h2", "h3", "h4")), ["page_id", "owner"])
    levels = nodes.filter(tag.isin("h2", "h3", "h4")).select("page_id", F.col("node").alias("owner"), F.substring("tag", 2, 1).cast("int").alias("level"))
    plain = F.regexp_replace(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    rows = heads.filter("content <> ''").join(levels, ["page_id", "owner"]).withColumn("slug", F.when(plain == "", "section").otherwise(plain))
    again = F.row_number().over(Window.partitionBy("page_id", "slug").orderBy("owner"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("owner"))
    return rows.select("page_id", nth.alias("nth"), "level", "content", F.concat("slug", F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise("")).alias("anchor"))


def image_sources(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, node, src``: the picture that each img shows: the biggest of its srcset, a lazy source, its src; resolved; 1-pixel trackers left out."""
    pixel = lambda n: F.coalesce(attr(n).rlike(r"^[01](?:px)?$"), F.lit(False))
    images = nodes.filter("tag = 'img'").filter(~(pixel("width") & pixel("height")))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    raw = F.coalesce(largest_in_srcset(attr("srcset")), largest_in_srcset(attr("data-srcset")), *[filled(attr(n)) for n in LAZY], filled(attr("src")))
    found = images.withColumn("raw", raw).filter("raw is not null").join(pages.select("page_id", "url"), "page_id")
    return found.select("page_id", "node", F.when(F.col("raw").startswith("data:"), F.col("raw")).otherwise(resolved(F.col("raw"), F.col("url"))).alias("src"))


def image_references(sources: DataFrame) -> DataFrame:
    """``page_id, urls``: a page's distinct http(s) pictures in order; none at all if there are more than 80."""
    first = sources.filter(F.col("src").rlike("^(?i)https?://")).groupBy("page_id", "src").agg(F.min("node").alias("node"))
    listed = first.groupBy("page_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node", "src"))).alias("l"))
    return listed.select("page_id", F.when(F.col("n") <= MAX_IMAGES, F.transform("l", lambda e: e["src"])).otherwise(F.array().cast("array<string>")).alias("urls"))


def embed_inventory(nodes: DataFrame) -> DataFrame:
    """``page_id, nth, src, kind, page, context``: the first 40 frames of a page with the 160 characters of text before each."""
    seen = without(nodes, F.col("tag").isin("script", "style", "head"))
    size = F.when(F.col("tag") == "#text", F.char_length("text")).otherwise(0)
    upto = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    frames = seen.withColumn("at", F.coalesce(F.sum(size).over(upto), F.lit(0))).filter("tag in ('iframe', 'embed', 'video', 'audio')").filter(attr("src").isNotNull())
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("node"))
    whole = seen.filter("tag = '#text'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda p: p["text"]), "").alias("whole"))
    some = frames.withColumn("nth", nth).filter(F.col("nth") <= MAX_EMBEDS).join(whole, "page_id", "left")
    start = F.greatest(F.col("at") - CONTEXT_CHARS, F.lit(0))
    context = F.trim(F.regexp_replace(F.substr("whole", (start + 1).cast("int"), (F.col("at") - start).cast("int")), r"\s+", " "))
    return some.select("page_id", "nth", attr("src").alias("src"), embed_kind(attr("src")).alias("e"), context.alias("context")).select("page_id", "nth", "src", "e.kind", "e.page", "context")


def footnotes(nodes: DataFrame) -> DataFrame:
    """``page_id, id, nth, node, note``: references to footnotes with their number among those to the same note, and the note's text; null if the page lacks it."""
    refs = nodes.filter("tag = 'a'").select("page_id", "node", F.regexp_extract(F.coalesce(attr("href"), F.lit("")), r"^#(fn[\w:.-]*)$", 1).alias("id")).filter("id <> ''")
    backs = inside(nodes, (F.col("tag") == "li") & F.coalesce(attr("id").rlike("^fn"), F.lit(False)), "in_note").filter("in_note and tag = 'a'").select("page_id", "node")
    is_note = (F.col("tag") == "li") & F.coalesce(attr("id").rlike("^fn"), F.lit(False))
    notes = texts(owned(without(nodes, (F.col("tag") == "a") & F.coalesce(attr("href").rlike("^#fnref"), F.lit(False))), is_note), ["page_id", "owner"])
    ids = nodes.filter(is_note).select("page_id", F.col("node").alias("owner"), attr("id").alias("id"))
    defined = notes.join(ids, ["page_id", "owner"]).groupBy("page_id", "id").agg(F.min_by("content", "owner").alias("note"))
    nth = F.row_number().over(Window.partitionBy("page_id", "id").orderBy("node"))
    return refs.join(backs, ["page_id", "node"], "left_anti").withColumn("nth", nth).join(defined, ["page_id", "id"], "left").select("page_id", "id", "nth", "node", "note")


def flow_texts(nodes: DataFrame) -> DataFrame:
    """``page_id, flow, tag, level, content``: every paragraph, heading, list item or cell of a page in order, empty ones left out."""
    kept = without(nodes, F.col("tag").isin(*UNSEEN, "head"))
    holders = kept.filter("tag <> '#text'").select("page_id", "node", F.col("tag").alias("holder"))
    parts = kept.filter("tag = '#text'").join(holders.withColumnRenamed("node", "parent"), ["page_id", "parent"], "left")
    first = parts.groupBy("page_id", "flow").agg(F.min_by("holder", "node").alias("tag"))
    return texts(kept, ["page_id", "flow"], breaks=True).filter("content <> ''").join(first, ["page_id", "flow"])


def representations(flows: DataFrame, budget: int = 8 * 1024 * 1024) -> DataFrame:
    """``page_id, markdown, plain, identity``: both texts of a page's flows in order and the SHA-256 of the markdown; null beyond the budget of bytes."""
    tag = F.col("tag")
    mark = F.when(tag.isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.greatest(F.substring(tag, 2, 1).try_cast("int"), F.lit(2))), F.lit(" "))).when(tag == "li", "- ").when(tag == "blockquote", "> ").otherwise("")
    escaped = F.regexp_replace("content", r"([\\`*_\[\]<>])", r"\\$1")
    listed = F.array_sort(F.collect_list(F.struct("flow", F.concat(mark, escaped).alias("md"), "content")))
    joined = lambda field: F.array_join(F.transform("l", lambda e: e[field]), "\n\n")
    both = flows.groupBy("page_id").agg(listed.alias("l")).select("page_id", joined("md").alias("markdown"), joined("content").alias("plain"))
    fits = F.octet_length("markdown") <= budget
    return both.select("page_id", F.when(fits, F.col("markdown")).alias("markdown"), F.when(fits, F.col("plain")).alias("plain"), F.when(fits, F.concat(F.lit("sha256:"), F.sha2("markdown", 256))).alias("identity"))


# Names of meta tags by vocabulary; types of JSON-LD nodes by kind.
HIGHWIRE = {"title": ("citation_title",), "date": ("citation_publication_date", "citation_date", "citation_online_date"), "publication": ("citation_journal_title", "citation_conference_title"), "doi": ("citation_doi",)}
DUBLIN = {"title": ("dc.title", "dcterms.title"), "date": ("dc.date", "dcterms.issued", "dcterms.created"), "publication": (), "doi": ()}
OPEN_GRAPH = {"title": ("og:title",), "date": ("article:published_time",), "publication": ("og:site_name",), "doi": ()}
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "ScholarlyArticle", "Report", "TechArticle")


def declared_metadata(nodes: DataFrame) -> DataFrame:
    """``page_id, highwire, dublin, open_graph, authors, json_ld``: what a page's head declares in each vocabulary, the first of each name."""
    named = nodes.filter("tag = 'meta'").select("page_id", "node", F.lower(F.coalesce(attr("name"), attr("property"))).alias("name"), F.trim(F.regexp_replace(attr("content"), r"\s+", " ")).alias("value"))
    first = lambda names: F.coalesce(*[F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("node"))) for n in names]) if names else F.lit(None).cast("string")
    layer = lambda words: F.struct(*[first(names).alias(field) for field, names in words.items()])
    authors = F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == "citation_author", F.struct("node", "value")))), lambda a: a["value"])
    metas = named.filter("value <> ''").groupBy("page_id").agg(layer(HIGHWIRE).alias("highwire"), layer(DUBLIN).alias("dublin"), layer(OPEN_GRAPH).alias("open_graph"), authors.alias("authors"))
    scripts = owned(nodes, (F.col("tag") == "script") & (attr("type") == "application/ld+json")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("owner", "text"))).alias("s"))
    typed = json_ld_nodes(F.transform("s", lambda x: x["text"]))
    ld = scripts.select("page_id", F.get(F.filter(typed, lambda n: F.arrays_overlap(n["types"], F.array(*[F.lit(t) for t in ARTICLE_TYPES]))), F.lit(0)).alias("json_ld"))
    return metas.join(ld, "page_id", "full_outer")


def json_ld_nodes(blocks: Column) -> Column:
    """array<struct<types, headline, published>> of JSON-LD texts: top-level nodes, members of arrays and of @graph, in order."""
    node = "struct<`@type`:string,headline:string,name:string,datePublished:string>"
    graph = f"struct<`@type`:string,headline:string,name:string,datePublished:string,`@graph`:array<{node}>>"

    def of(block: Column) -> Column:
        one = F.from_json(block, graph)
        many = F.from_json(block, f"array<{node}>")
        inner = F.coalesce(one["@graph"], F.array().cast(f"array<{node}>"))
        own = F.array(F.struct(*[one[c].alias(c) for c in ("@type", "headline", "name", "datePublished")]))
        return F.when(F.trim(block).startswith("["), F.coalesce(many, F.array().cast(f"array<{node}>"))).otherwise(F.concat(own.cast(f"array<{node}>"), inner))

    plain = lambda n: F.struct(F.split(F.regexp_replace(F.coalesce(n["@type"], F.lit("")), r'[\[\]"\s]', ""), ",").alias("types"), F.coalesce(n["headline"], n["name"]).alias("headline"), n["datePublished"].alias("published"))
    return F.transform(F.flatten(F.transform(blocks, of)), plain)


def inferred_kind(origin: Column, media_type: Column, arxiv: Column, conference: Column, journal: Column, item_kind: Column) -> Column:
    """The kind of a material by what is known of it, the first rule that holds."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(origin == "agent", "note").when(known(arxiv), "preprint").when(conference, "conferencePaper").when(journal, "journalArticle").when(known(item_kind), item_kind)
        .when(origin == "feed", "blogPost").when(media_type == "application/pdf", "document").otherwise("webpage")
    )
