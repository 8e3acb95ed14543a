"""Titles, bylines, creators and how they are cited."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papershed.functions.text import collapsed, comparison_key

MAX_CREATORS, LONGEST_NAME, LONGEST_TITLE = 100, 120, 500
# What stands between a title and its site; what stands before and after names; kinds and the entries they are cited as.
SEPARATOR = r"\s+(?:\||–|—|-|·|»|::)\s+"
BEFORE_NAME = r"^(?i)(?:by|author|posted by|written by|作者)[:：\s]+"
AFTER_NAME = r"(?i)[,\s]*(?:view all posts.*|all posts by.*|posted (?:on|in).*|\d{1,2}\s+\w+\s+\d{4}.*|\w+\s+\d{1,2},\s+\d{4}.*)$"
ENTRY_TYPES = {
    "journalArticle": "article", "conferencePaper": "inproceedings", "book": "book", "bookSection": "incollection", "report": "techreport", "thesis": "phdthesis",
}
OTHER_ENTRY = "misc"
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEB_KINDS = ("webpage", "blogPost", "newsletter", "newsArticle", "document", "note")


def heading_key(text: Column) -> Column:
    """White space collapsed, lower case, without marks at the end: what a heading is known by."""
    return F.regexp_replace(F.lower(collapsed(text)), r"[\p{P}\s]+$", "")


def without_site(title: Column, extracted: Column, site: Column) -> Column:
    """A declared title without its site's side: the side equal to the extracted title, else without the end that is the site's name."""
    marked = F.regexp_replace(title, rf"({SEPARATOR})", "\u0000$1\u0000")
    tokens = F.split(marked, "\u0000")
    whole, name = F.coalesce(comparison_key(extracted), F.lit("")), F.coalesce(comparison_key(site), F.lit(""))
    joined = lambda a, n: F.array_join(F.slice(tokens, a, F.greatest(n, F.lit(0))), "")
    n = F.size(tokens)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k % 2 == 1) & (k < n))
    sides = F.flatten(F.transform(ends, lambda k: F.array(joined(F.lit(1), k), joined(k + 2, n - k - 1))))
    same = F.get(F.filter(sides, lambda s: (whole != "") & (comparison_key(s) == whole)), F.lit(0))
    last, first = F.get(tokens, n - 1), F.get(tokens, F.lit(0))
    return (
        F.when((n < 3) | ((whole != "") & (comparison_key(title) == whole)), title)
        .when(same.isNotNull(), F.trim(same))
        .when((name != "") & (comparison_key(last) == name), F.trim(joined(F.lit(1), n - 2)))
        .when((name != "") & (comparison_key(first) == name), F.trim(joined(F.lit(3), n - 2)))
        .otherwise(title)
    )


def chosen_title(candidates: Column, site_names: Column) -> Column:
    """The first candidate (array) that isn't a site's name, number or shorter than 3 after sides that are site names are dropped; a
    shorter candidate of 8 characters or more that it begins with wins; 500 characters at most."""
    names = F.transform(site_names, F.lower)
    bare = lambda t: F.regexp_replace(t, r"^[\s¶#]+|[\s¶#]+$", "")

    def clean(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(bare(t), SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")
        kept = F.filter(parts, lambda p: ~F.array_contains(names, F.lower(p)))
        return bare(F.when((F.size(parts) < 2) | (F.size(kept) == F.size(parts)) | (F.size(kept) == 0), bare(t)).otherwise(F.array_join(kept, " – ")))

    cleaned = F.filter(F.transform(F.array_compact(candidates), clean), lambda t: t != "")
    fine = F.filter(cleaned, lambda t: ~F.array_contains(names, F.lower(t)) & ~t.rlike(r"^\d+$") & (F.char_length(t) >= 3))
    best = F.get(fine, F.lit(0))
    shorter = F.get(F.filter(cleaned, lambda t: (t != best) & (F.char_length(t) >= 8) & F.startswith(best, t)), F.lit(0))
    return F.substring(F.coalesce(shorter, best, F.get(F.filter(candidates, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))), 1, LONGEST_TITLE)


def clean_byline(text: Column) -> Column:
    """A byline without what stands before and after the names; null unless 2 to 120 characters are left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(collapsed(text), BEFORE_NAME, ""), AFTER_NAME, ""))
    return F.when(F.char_length(bare).between(2, LONGEST_NAME) & ~F.lower(bare).isin("by", "author"), bare)


def creator(name: Column, role: str = "author") -> Column:
    """struct<role, name, given, family>: "Family, Given" is taken apart, anything else stays as shown; null if empty."""
    shown = collapsed(name)
    parts = F.transform(F.split(shown, ","), lambda p: F.trim(p))
    two = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    family, given = F.when(two, F.get(parts, F.lit(0))), F.when(two, F.get(parts, F.lit(1)))
    full = F.when(two, F.concat(given, F.lit(" "), family)).otherwise(shown)
    return F.when(shown != "", F.struct(F.lit(role).alias("role"), full.alias("name"), given.alias("given"), family.alias("family")))


def creators_of_byline(byline: Column) -> Column:
    """The authors of "By A, B and C"; names are cut at commas, ``and``, ``&`` and middle dots."""
    parts = F.split(F.regexp_replace(byline, r"^(?i)\s*by\s+", ""), r",|\band\b|&|·")
    return F.slice(F.array_compact(F.transform(parts, lambda p: creator(p))), 1, MAX_CREATORS)


def byline_of(creators: Column) -> Column:
    """Authors joined, else editors marked as such, else all; null without any."""
    of = lambda role: F.transform(F.filter(creators, lambda c: c["role"] == role), lambda c: c["name"])
    editors = F.transform(of("editor"), lambda n: F.concat(n, F.lit(" (ed.)")))
    text = lambda a: F.array_join(a, ", ")
    return F.when(F.size(of("author")) > 0, text(of("author"))).when(F.size(editors) > 0, text(editors)).when(F.size(creators) > 0, text(F.transform(creators, lambda c: c["name"])))


def citation_names(creators: Column) -> Column:
    """Up to three names joined with "and"; of more the first "et al."; authors alone if there are any."""
    authors = F.filter(creators, lambda c: c["role"] == "author")
    names = F.filter(F.transform(F.when(F.size(authors) > 0, authors).otherwise(creators), lambda c: c["name"]), lambda n: n != "")
    n, at = F.size(names), lambda k: F.get(names, k)
    return (
        F.when(n == 0, "").when(n > 3, F.concat(at(F.lit(0)), F.lit(" et al."))).when(n == 1, at(F.lit(0)))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), at(n - 1)))
    )


def citation_line(creators: Column, date: Column, title: Column, publication: Column, url: Column) -> Column:
    """Names (Year). *Title*. Publication. <url>: whatever parts there are."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    sentence = lambda t: F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
    year = F.regexp_extract(filled(date), r"^(\d{4})", 1)
    head = F.array_join(F.filter(F.array(filled(citation_names(creators)), F.when(year != "", F.concat(F.lit("("), year, F.lit(")"))).otherwise("")), lambda p: p != ""), " ")
    parts = F.array(F.when(head != "", sentence(head)).otherwise(""), F.concat(F.lit("*"), F.trim(title), F.lit("*.")), F.when(filled(publication) != "", sentence(publication)).otherwise(""))
    link = F.when(filled(url) != "", F.concat(F.lit(" <"), url, F.lit(">"))).otherwise("")
    return F.concat(F.array_join(F.filter(parts, lambda p: p != ""), " "), link)


def _ascii(text: Column) -> Column:
    """Lower-case ASCII letters and digits; accents of Latin letters fall off."""
    return F.regexp_replace(F.lower(F.translate(text, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")), "[^a-z0-9]", "")


def bibtex_key(creators: Column, title: Column, date: Column, fallback: Column) -> Column:
    """Family of the first author, year and first word of the title; without an author the title's word and the year; else the fallback."""
    author = F.get(F.filter(creators, lambda c: c["role"] == "author"), F.lit(0))
    family = F.coalesce(author["family"], F.regexp_extract(F.trim(author["name"]), r"(\S+)$", 1))
    word = _ascii(F.coalesce(F.regexp_extract(F.trim(title), r"^(\S+)", 1), F.lit("")))
    head = F.when(author.isNotNull(), _ascii(F.coalesce(family, F.lit("")))).otherwise(word)
    year = F.coalesce(F.substring(date, 1, 4), F.lit(""))
    return F.when(head == "", F.concat(_ascii(fallback), year)).otherwise(F.concat(head, year, F.when(author.isNotNull(), word).otherwise("")))


def bibtex(meta: Column, fallback: Column) -> Column:
    """One BibTeX entry of a metadata struct (kind, title, creators, publication, volume, issue, pages, publisher, place, edition,
    series, date, doi, isbn, issn, arxiv_id, url, extra, accessed)."""
    m = lambda name: F.nullif(meta[name], F.lit(""))
    escaped = lambda t: F.regexp_replace(t, r"([{}&%#_$])", r"\\$1")
    braced = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    people = lambda role: F.nullif(F.array_join(F.transform(F.filter(meta["creators"], lambda c: c["role"] == role), lambda c: F.when(c["family"].isNotNull() & c["given"].isNotNull(), F.concat(c["family"], F.lit(", "), c["given"])).otherwise(c["name"])), " and "), F.lit(""))
    kind = F.coalesce(m("kind"), F.lit("webpage"))
    entry = F.coalesce(*[F.when(kind == k, e) for k, e in ENTRY_TYPES.items()], F.lit(OTHER_ENTRY))
    pages = F.regexp_replace(m("pages"), r"(\d)\s*[-–]\s*(\d)", "$1--$2")
    month = F.substring(m("date"), 6, 2).try_cast("int")
    field = lambda name, value: braced(name, escaped(value))
    by_entry = {
        "article": [("journal", m("publication")), ("volume", m("volume")), ("number", m("issue")), ("pages", pages), ("issn", m("issn"))],
        "inproceedings": [("booktitle", m("publication")), ("pages", pages), ("publisher", m("publisher")), ("address", m("place")), ("isbn", m("isbn"))],
        "book": [("publisher", m("publisher")), ("address", m("place")), ("edition", m("edition")), ("series", m("series")), ("isbn", m("isbn"))],
        "incollection": [("booktitle", m("publication")), ("pages", pages), ("publisher", m("publisher")), ("address", m("place")), ("edition", m("edition")), ("isbn", m("isbn"))],
        "techreport": [("institution", m("publisher")), ("address", m("place")), ("number", m("series"))],
        "phdthesis": [("school", m("publisher")), ("address", m("place"))],
    }
    own = F.array().cast("array<string>")
    for name, fields in by_entry.items():
        own = F.when(entry == name, F.array(*[field(n, v) for n, v in fields])).otherwise(own)
    arxiv = m("arxiv_id")
    primary = F.nullif(F.regexp_extract(m("extra"), r"(?i)arxiv:[^\n]*\[([\w.-]+)\]", 1), F.lit(""))
    preprint = F.array(field("eprint", arxiv), F.when(arxiv.isNotNull(), field("archivePrefix", F.lit("arXiv"))), F.when(arxiv.isNotNull(), field("primaryClass", primary)), field("publisher", m("publisher")))
    web = F.array(braced("howpublished", F.concat(F.lit("\\url{"), m("url"), F.lit("}"))), field("publisher", m("publisher")))
    own = F.when(entry != OTHER_ENTRY, own).when(kind == "preprint", preprint).otherwise(web)
    accessed = F.substring(m("accessed"), 1, 10)
    lines = F.concat(
        F.array(field("author", people("author")), field("editor", people("editor")), braced("title", F.concat(F.lit("{"), escaped(m("title")), F.lit("}")))),
        own,
        F.array(
            field("year", F.substring(m("date"), 1, 4)), F.when(month.between(1, 12), F.concat(F.lit("  month = "), F.get(F.array(*[F.lit(n) for n in MONTH_NAMES]), month - 1))),
            field("doi", m("doi")), field("url", m("url")), field("urldate", accessed), F.when(kind.isin(*WEB_KINDS), field("note", F.concat(F.lit("Accessed "), accessed))),
        ),
    )
    key = bibtex_key(meta["creators"], m("title"), m("date"), fallback)
    return F.concat(F.lit("@"), entry, F.lit("{"), key, F.lit(",\n"), F.array_join(F.array_compact(lines), ",\n"), F.lit("\n}"))
