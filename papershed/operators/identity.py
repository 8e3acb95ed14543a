"""Which material a link or a fetched page is: by the URLs it was read from, the canonical link it declares, its DOI and its arXiv id.

Keys have name spaces, so a declared canonical link matches a URL that a material was read from and never another
declaration. A request's keys come in order; the first that names a material decides, and of several materials the one fetched first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.functions.text import arxiv_id
from papershed.functions.urls import canonical_url
from papershed.operators.library import resolve


def _named(space: str, value: Column) -> Column:
    """``space:value``; null for a null or empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{space}:"), value))


def _listed(*keys: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*keys)))


def url_names(url: Column, final_url: Column, aliases: Column) -> Column:
    """The URLs that a material was read from or opened by, without tracking parameters, each once; links that aren't http(s) don't count."""
    every = F.filter(F.concat(F.array(url, final_url), F.coalesce(aliases, F.array().cast("array<string>"))), lambda u: F.coalesce(u.rlike(r"^(?i)https?://"), F.lit(False)))
    return F.array_distinct(F.transform(every, canonical_url))


def record_keys(url: Column, final_url: Column, aliases: Column, canonical: Column, doi: Column, arxiv: Column) -> Column:
    """Every key that a stored material answers to."""
    urls = F.transform(url_names(url, final_url, aliases), lambda u: F.concat(F.lit("url:"), u))
    return F.array_distinct(F.concat(urls, _listed(_named("canonical", canonical), _named("doi", doi), _named("arxiv", arxiv))))


def request_keys(url: Column) -> Column:
    """What a link names before it is fetched: a URL that was read or declared, or an arXiv paper."""
    return _listed(_named("url", canonical_url(url)), _named("canonical", canonical_url(url)), _named("arxiv", arxiv_id(url)))


def page_keys(final_url: Column, declared: Column, doi: Column, arxiv: Column) -> Column:
    """What a fetched page names: where the fetch ended, the canonical link that it declares, its DOI and arXiv id."""
    return F.array_distinct(F.concat(request_keys(final_url), _listed(_named("url", declared), _named("doi", doi), _named("arxiv", arxiv))))


def _ranked(keys: Column) -> Column:
    return F.transform(keys, lambda k, i: F.struct(i.alias("priority"), k.alias("key")))


def identified(requests: DataFrame, records: DataFrame) -> DataFrame:
    """``request_id, id`` of requests (``request_id, keys``) that name a stored material (``id, fetched_s, keys``).

    Keys meet in one equi-join in which a key's materials are reduced to the first fetched before, so common keys don't multiply.
    """
    return resolve(requests.select("request_id", _ranked(F.col("keys")).alias("keys")), records.select("id", "fetched_s", _ranked(F.col("keys")).alias("keys")))


def with_aliases(names: Column, canonical: Column, aliases: Column, opened: Column) -> Column:
    """A material's aliases after it was opened by other URLs: those that it isn't named by yet join, without tracking parameters."""
    new = F.transform(F.filter(opened, lambda u: F.coalesce(u.rlike(r"^(?i)https?://"), F.lit(False))), canonical_url)
    return F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array_except(new, F.concat(names, F.array_compact(F.array(canonical)))))
