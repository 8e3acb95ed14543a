"""Page metadata and outlines in Catalyst expressions over the html column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def meta_tags(html: Column) -> Column:
    """array<struct<name, content>> of a page's meta tags, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    attribute = lambda t, n: F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?is)\s{n}\s*=\s*{q}([^{e}]*){q}", 1), F.lit("")) for q, e in (('"', '"'), ("'", "'"))])
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))).alias("name"), attribute(t, "content").alias("content")))
    return F.filter(pairs, lambda p: p["name"].isNotNull() & p["content"].isNotNull())


def meta_values(tags: Column, name: str) -> Column:
    return F.transform(F.filter(tags, lambda t: t["name"] == name), lambda t: t["content"])


def first_meta(tags: Column, *names: str) -> Column:
    """The first value of the first name that has one: the order of names is the order of precedence."""
    return F.coalesce(*[F.get(meta_values(tags, n), F.lit(0)) for n in names])


def title_of(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def canonical_link(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<link\s[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page, as text."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def article_region(html: Column) -> Column:
    """The content of the only article element, else of the only main element, else null."""
    def only(name: str) -> Column:
        n = F.regexp_count(html, F.lit(rf"(?i)<{name}[\s>]"))
        return F.when(n == 1, F.nullif(F.regexp_extract(html, rf"(?is)<{name}(?:\s[^>]*)?>(.*)</{name}\s*>", 1), F.lit("")))

    return F.coalesce(only("article"), only("main"))


def element_counts(html: Column, *names: str) -> Column:
    """struct of how often each element is opened."""
    return F.struct(*[F.regexp_count(html, F.lit(rf"(?i)<{n}(?=[\s>/])")).alias(n) for n in names])


def flattened(html: Column) -> Column:
    """Text without tags, scripts and styles; white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def generator(html: Column) -> Column:
    """What made the site: the generator tag, else a known mark of the page, else empty."""
    return F.coalesce(
        first_meta(meta_tags(html), "generator"),
        F.when(html.contains("/wp-content/"), "WordPress").when(html.contains("substackcdn.com"), "Substack").when(html.contains("data-astro-"), "Astro").when(html.contains("/_next/static/"), "Next.js"),
        F.lit(""),
    )


def closed_references(html: Column) -> Column:
    """Markup in which an ampersand that begins no reference with a semicolon (of a text cut short, say) stands for itself."""
    return F.regexp_replace(html, r"&(?!#?\w+;)", "&amp;")
