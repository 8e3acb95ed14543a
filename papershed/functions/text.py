"""Text, identifier and version expressions. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers count it.
SPACE = r"[\s   -     　﻿]+"
GIST_MOST, GIST_LEAST = 300, 100
WORDS_A_MINUTE, CJK_A_MINUTE = 240, 400
#: Characters whose capitals are several characters, and the one that stands for each.
WIDENED = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def capitals(text: Column) -> Column:
    """The text in capitals, a character for each, so that places in it stay."""
    wide = "".join(WIDENED)
    parts = F.split(text, f"(?<=[{wide}])|(?=[{wide}])")
    each = F.transform(parts, lambda p: F.when(p.rlike(f"[{wide}]"), F.translate(p, wide, "".join(WIDENED.values()))).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{wide}]"), F.array_join(each, "")).otherwise(F.upper(text))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def gist(text: Column) -> Column:
    """At most 300 characters: up to the last sentence end with a space after it (or 。) if that is at 100 or later, else the last space and an ellipsis."""
    plain = collapsed(text)
    head = F.substring(plain, 1, GIST_MOST)
    upto_sentence = F.regexp_extract(head, r"^(.*(?:[.!?](?= )|。))", 1)
    upto_space = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    return (
        F.when(F.char_length(plain) <= GIST_MOST, plain)
        .when(F.char_length(upto_sentence) > GIST_LEAST, upto_sentence)
        .otherwise(F.concat(F.trim(F.when(upto_space != "", upto_space).otherwise(head)), F.lit("…")))
    )


def comparison_key(text: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


ARXIV = r"(?i)arxiv\.org/(?:abs|pdf|html)/([a-z-]+/\d{7}|\d{4}\.\d{4,5})(?:v(\d+))?"


def arxiv_id(text: Column) -> Column:
    """The identifier, old or new style and without version, that a link to arxiv.org in a text names; else null."""
    return F.nullif(F.regexp_extract(text, ARXIV, 1), F.lit(""))


def normal_arxiv_id(text: Column) -> Column:
    """``arXiv:2409.12345v2`` or a bare id without prefix and version; other text as it is; null if empty."""
    bare = F.regexp_replace(F.trim(text), r"^(?i)arxiv:\s*", "")
    return F.coalesce(arxiv_id(F.concat(F.lit("arxiv.org/abs/"), bare)), F.nullif(bare, F.lit("")))


def arxiv_version(url: Column, text: Column) -> Column:
    """The version that a link asks for, else the highest that a text stamps on the same paper; null if neither says one."""
    asked = F.regexp_extract(url, ARXIV, 2).try_cast("int")
    stamps = F.regexp_extract_all(text, F.concat(F.lit(r"(?<![\w.])"), F.replace(arxiv_id(url), F.lit("."), F.lit(r"\.")), F.lit(r"v(\d+)")), F.lit(1))
    return F.coalesce(asked, F.array_max(F.transform(stamps, lambda v: v.try_cast("int"))))


def doi(text: Column) -> Column:
    """Lower-case DOI without prefix if it is one, else null."""
    bare = F.lower(F.regexp_replace(F.trim(text), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def version_key(tag: Column) -> Column:
    """A key by which versions sort: major, minor, patch, whether final, and the prerelease's parts; null for what is no version.

    Numbers of any length are text with their length in front, so they compare as numbers; among
    prerelease parts a number comes before a word and a shorter list before a longer one.
    """
    form = r"^\s*v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
    part = lambda k: F.regexp_extract(tag, form, k)
    tail = F.split(part(4), r"\.")
    pre = F.transform(tail, lambda t: F.when(t.rlike(r"^\d+$"), F.concat(F.lit("0"), _ordered(t))).otherwise(F.concat(F.lit("1"), t)))
    fine = tag.rlike(form) & ((part(4) == "") | ~F.array_contains(tail, ""))
    none = F.array().cast("array<string>")
    return F.when(fine, F.struct(*[_ordered(part(k)).alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))], (part(4) == "").alias("final"), F.when(part(4) == "", none).otherwise(pre).alias("pre")))


def _ordered(digits: Column) -> Column:
    """Digits as text that compares as the number does."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.char_length(bare).cast("string"), 4, "0"), bare)


def natural_key(title: Column) -> Column:
    """A sort key in which runs of digits, however long, compare as numbers, whatever the case."""
    parts = F.regexp_extract_all(F.lower(title), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), _ordered(p)).otherwise(p)), "")


# White space and punctuation between words of East Asian text.
CJK_MARKS = r"[\u2000-\u206f\u3000-\u303f\uff00-\uffef]"


def word_count(text: Column) -> Column:
    """Words between white space, and every CJK character as one."""
    return _words(text) + F.regexp_count(text, F.lit(CJK))


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, CJK_MARKS, " "), CJK, " ")
    return F.size(F.filter(F.split(plain, SPACE), lambda w: w != ""))


def reading_minutes(text: Column) -> Column:
    """240 words or 400 CJK characters a minute, rounded half up, one at least."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.greatest(F.lit(1), F.floor(_words(text) / WORDS_A_MINUTE + cjk / CJK_A_MINUTE + 0.5)).cast("int")


def entities_decoded(text: Column) -> Column:
    """The five named XML entities and numeric ones below U+10000 as characters; unknown ones stay."""
    # Named entities. The ampersand comes last, so that nothing is decoded twice.
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    pieces = F.regexp_extract_all(text, F.lit(r"&#(?:x[0-9a-fA-F]{1,4}|\d{1,5});|[^&]+|&"), F.lit(0))

    def one(piece: Column) -> Column:
        hexed, dec = F.regexp_extract(piece, r"^&#x([0-9a-fA-F]+);$", 1), F.regexp_extract(piece, r"^&#(\d+);$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("int")).otherwise(dec.try_cast("int"))
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0xFFFF)
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise(piece)

    return F.replace(F.array_join(F.transform(pieces, one), ""), F.lit("&amp;"), F.lit("&"))


def cut_to_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of a text with so many UTF-8 bytes at most, cut between code points."""
    kept = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # The cut is before a continuation byte if the byte after it is one: then the last, unfinished code point goes.
    after = F.hex(F.substring(F.encode(text, "UTF-8"), limit + 1, 1))
    unfinished = after.rlike("^[89AB]")
    trimmed = F.unhex(F.regexp_replace(F.hex(kept), "(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F]){0,3}$", ""))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.when(unfinished, trimmed).otherwise(kept), "UTF-8"))
