"""Checks of what agents write, quotes found again though texts changed, pictures matched one to one, rules of the judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.text import collapsed, let, word_count

LONGEST_SOURCE, MAX_NOTES, LONG_PARAGRAPH, SECTIONLESS, LONGEST_TITLE = 400_000, 6, 170, 400, 90
INPUT_CHARS = 60_000
# Titles and headings that say nothing; filler; notices and blocks beyond an article; services beyond an article.
GENERIC = r"(?i)^(?:untitled|summary|overview|report|notes|analysis|introduction|conclusion)$"
FILLER = r"(?i)\b(?:in conclusion|it is worth noting|it's important to note|delve into|in today's world)\b"
NOTICE = r"(?i)(?:©|\(c\)\s*\d{4}|copyright\b|all rights reserved|licen[cs]ed under|creative commons|\bCC BY\b|apache license|\bMIT licen[cs]e|trademarks? of|registered trademark|版权所有|保留所有权利|许可协议)"
CITE_BLOCK = r"(?im)\bBibTeX\b|@(?:article|misc|online|inproceedings|book)\s*\{|^\s*(?:cited as|please cite|citation)\b"
CONTINUATION = "[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
MOJIBAKE = f"[Â-ß]{CONTINUATION}|[à-ï]{CONTINUATION}{{2}}|[ð-ô]{CONTINUATION}{{3}}"


def source_problem(kind: Column, source: Column) -> Column:
    """Why an artifact's source can't be saved, null if it can."""
    return (
        F.when(F.trim(source) == "", "empty").when(F.char_length(source) > LONGEST_SOURCE, "too long").when((kind == "svg") & ~source.rlike(r"(?i)<svg[\s>]"), "no svg element")
        .when((kind == "html") & ~source.rlike(r"(?is)<[a-z].*>"), "no markup")
    )


def edited_once(source: Column, old: Column, new: Column) -> Column:
    """struct<text, problem>: the source with a passage replaced that must occur exactly once, overlapping places counted."""
    first = F.position(old, source)
    again = F.position(old, source, first + 1)
    problem = F.when(old == "", "empty").when(first == 0, "absent").when(again > 0, "repeated")
    done = F.concat(F.substr(source, F.lit(1), first - 1), new, F.substr(source, first + F.char_length(old)))
    return F.struct(F.when(problem.isNull(), done).alias("text"), problem.alias("problem"))


def editor_notes(title: Column, source: Column, cites: Column) -> Column:
    """What an editor would ask to fix in a Markdown artifact, six rules at most, in order; ``cites``: it has sources."""
    body = F.regexp_replace(source, r"^\s*#\s+[^\n]*\n", "")
    blocks = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    headings = F.filter(blocks, lambda b: b.rlike(r"^#{2,6}\s"))
    citations, quoted = F.regexp_count(body, F.lit(r"\[[a-f0-9]{16}\]")), F.regexp_count(body, F.lit("[\"”]\\s*\\[[a-f0-9]{16}\\]"))
    prose = F.filter(blocks, lambda b: ~b.rlike(r"^(?:#|\||```|>|[-*+] |\d+\. )") & (word_count(b) > LONG_PARAGRAPH))
    rules = (
        ("title", F.trim(title).rlike(GENERIC)), ("long_title", F.char_length(title) > LONGEST_TITLE), ("lead", (F.size(headings) > 0) & F.get(blocks, F.lit(0)).rlike(r"^#{1,6}\s")),
        ("sections", (F.size(headings) == 0) & (word_count(body) > SECTIONLESS)), ("heading", F.exists(headings, lambda h: F.regexp_replace(h, r"^#+\s*", "").rlike(GENERIC))),
        ("citations", cites & (citations == 0)), ("quotes", (citations >= 4) & (quoted * 2 < citations)), ("filler", body.rlike(FILLER)), ("paragraph", F.size(prose) > 0),
        ("emoji", body.rlike("[\U0001f300-\U0001faff]")),
    )
    return F.slice(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])), 1, MAX_NOTES)


def shortened_input(text: Column) -> Column:
    """A text as a judge gets it: 60,000 characters at most, with a mark where it was cut."""
    return F.when(F.char_length(text) <= INPUT_CHARS, text).otherwise(F.concat(F.substring(text, 1, INPUT_CHARS), F.lit("\n[truncated]")))


def evidence_occurs(evidence: Column, text: Column) -> Column:
    """Whether a quote is in a text: white space never counts, nor does markup if the plain quote isn't found."""
    squashed = lambda t: F.regexp_replace(t, r"\s+", "")
    plain = lambda t: squashed(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>|!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[\\*_`#>~|]+", ""))
    bare = F.regexp_replace(evidence, r"\s*(?:…|\.\.\.)\s*$", "")
    return (squashed(bare) != "") & (F.contains(squashed(text), squashed(bare)) | ((plain(bare) != "") & F.contains(plain(text), plain(bare))))


def section_shown(evidence: Column, source: Column, shown: Column) -> Column:
    """Whether a reader shows a quote of three words or more with every line of its section of the source, by words."""
    words = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))
    quote, seen = words(evidence), F.concat(F.lit(" "), words(shown), F.lit(" "))
    marked = F.regexp_replace(source, r"(?m)^(?=#{1,6} )", "\u0000")
    sections = F.filter(F.split(marked, "\u0000"), lambda s: F.contains(F.concat(F.lit(" "), words(s), F.lit(" ")), F.concat(F.lit(" "), quote, F.lit(" "))))
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), words), lambda w: w != "")
    whole = F.exists(sections, lambda s: F.forall(lines(s), lambda w: F.contains(seen, F.concat(F.lit(" "), w, F.lit(" ")))))
    return (F.size(F.split(quote, " ")) >= 3) & F.contains(seen, F.concat(F.lit(" "), quote, F.lit(" "))) & whole


def beyond_article(kind: Column, evidence: Column) -> Column:
    """Why a claim of missing content is about text that is no part of an article: ``notice``, ``citation`` or null."""
    return F.when(kind == "missing_content", F.when(evidence.rlike(NOTICE), "notice").when(evidence.rlike(CITE_BLOCK), "citation"))


def normal_issue(issue: Column, unmatched: Column, broken: Column) -> Column:
    """An issue struct<layer, kind, severity, subject, refs> as the rules set it, with what it was before where that differs.

    An issue about metadata or with a subject is in the metadata layer, a title major, author and date minor. Others that cite a picture
    that the reader lacks (``unmatched``: its ids) are about content, those that cite a broken one about rendering, content winning;
    content kept from beyond the article is minor.
    """
    subject, kind = issue["subject"], issue["kind"]
    meta = (kind == "metadata") | subject.isNotNull()
    fixed = F.when(subject == "title", "major").when(subject.isNotNull(), "minor")
    refs = F.coalesce(issue["refs"], F.array().cast("array<string>"))
    by_facts = F.when(F.arrays_overlap(refs, unmatched), "content").when(F.arrays_overlap(refs, broken), "rendering")
    layer = F.when(meta, "metadata").otherwise(F.coalesce(by_facts, issue["layer"]))
    severity = F.when(meta, F.coalesce(fixed, issue["severity"])).when(kind == "extra_content", "minor").otherwise(issue["severity"])
    was = lambda new, old: F.when(new != old, old)
    return F.struct(layer.alias("layer"), kind.alias("kind"), severity.alias("severity"), subject.alias("subject"), refs.alias("refs"), was(layer, issue["layer"]).alias("was_layer"), was(severity, issue["severity"]).alias("was_severity"))


def reported_issue(issue: Column) -> Column:
    """A normal issue as it was reported, for scoring it again under new facts or rules."""
    return F.struct(F.coalesce(issue["was_layer"], issue["layer"]).alias("layer"), issue["kind"].alias("kind"), F.coalesce(issue["was_severity"], issue["severity"]).alias("severity"), issue["subject"].alias("subject"), issue["refs"].alias("refs"))


POLICIES = ("single", "screen-then-confirm", "both")


def policy_key(policy: str, judges: list[str], escalate_on: list[str] = ()) -> str:
    """What names a policy in a cache key; an unknown policy, a wrong number of judges, or nothing to escalate on is an error."""
    if policy not in POLICIES or len(judges) != (1 if policy == "single" else 2) or (policy == "screen-then-confirm") != bool(escalate_on):
        raise ValueError(f"invalid policy {policy!r} of {len(judges)} judges")
    if policy == "screen-then-confirm":
        return f"{policy} {judges[0]} > {judges[1]} on {','.join(sorted(escalate_on))}"
    return f"{policy} {' + '.join(judges)}"


def case_key(source: Column, extracted: Column, rubric: str, policy: str) -> Column:
    """The cache key of a judged case: a hash of its texts, rubric and policy."""
    return F.sha2(F.concat_ws("\u0000", source, extracted, F.lit(rubric), F.lit(policy)), 256)


def resolved_case(policy: str, screen: Column, confirm: Column, merged: Column, escalate_on: list[str] = ()) -> Column:
    """struct<verdict, source, disputed> of a case by its opinions' verdicts and the merged one; null while an opinion is missing."""
    one = F.struct(screen.alias("verdict"), F.lit("screen").alias("source"), F.lit(False).alias("disputed"))
    two = F.when(confirm.isNotNull(), F.struct(merged.alias("verdict"), F.lit("merged").alias("source"), (screen != confirm).alias("disputed")))
    if policy == "single":
        return F.when(screen.isNotNull(), one)
    if policy == "screen-then-confirm":
        return F.when(screen.isNotNull(), F.when(screen.isin(*escalate_on), two).otherwise(one))
    return F.when(screen.isNotNull(), two)


def matched_images(reference: DataFrame, rendered: DataFrame, tiers: tuple[str, ...] = ("url", "path", "stem")) -> DataFrame:
    """``case, ref, image, tier``: reference pictures with the rendered ones that are the same, one to one.

    Both sides have ``case, ord`` and the keys of the tiers. Tier by tier, the reference pictures in order claim the first
    rendered one of their key that is left; with one key a side that is the n-th with the n-th among those left, so a tier is two row
    numbers and a join.
    """
    left_ref, left_image, found = reference, rendered, None
    for tier in tiers:
        nth = F.row_number().over(Window.partitionBy("case", tier).orderBy("ord"))
        a = left_ref.filter(F.col(tier).isNotNull()).select("case", tier, F.col("ord").alias("ref"), nth.alias("nth"))
        b = left_image.filter(F.col(tier).isNotNull()).select("case", tier, F.col("ord").alias("image"), nth.alias("nth"))
        pairs = a.join(b, ["case", tier, "nth"]).select("case", "ref", "image", F.lit(tier).alias("tier"))
        found = pairs if found is None else found.unionByName(pairs)
        left_ref = left_ref.join(pairs.select("case", F.col("ref").alias("ord")), ["case", "ord"], "left_anti")
        left_image = left_image.join(pairs.select("case", F.col("image").alias("ord")), ["case", "ord"], "left_anti")
    return found


def aligned_sources(known: Column, payload: Column) -> Column:
    """The addresses of pictures in order: a known one advances in the payload to its place, an unknown one takes the next; "" beyond its end."""

    def step(acc: Column, url: Column) -> Column:
        at = acc["next"]
        ahead = F.array_position(F.slice(payload, at + 1, F.greatest(F.size(payload) - at, F.lit(0))), url).cast("int")
        after = F.when(F.coalesce(url, F.lit("")) == "", F.least(at + 1, F.size(payload))).when(ahead > 0, at + ahead).otherwise(at)
        shown = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.coalesce(F.get(payload, at), F.lit("")))
        return F.struct(after.alias("next"), F.array_append(acc["out"], shown).alias("out"))

    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(known, zero, step, lambda acc: acc["out"])


def mirrored(annotations: DataFrame, quotes_in: DataFrame) -> DataFrame:
    """Annotations ``material, id, view, quote, start, stop`` as each view of their material (``material, view, text``) shows them: its own as they are, those
    of other views at the first place of their quote; unmapped ones are left out."""
    pairs = annotations.join(quotes_in.withColumnsRenamed({"view": "shown", "text": "_text"}), "material")
    at = F.position(F.col("quote"), F.col("_text"))
    own = F.col("view") == F.col("shown")
    placed = pairs.withColumn("start", F.when(own, F.col("start")).otherwise(at - 1)).withColumn("stop", F.when(own, F.col("stop")).otherwise(at - 1 + F.char_length("quote")))
    return placed.filter(own | (at > 0)).drop("_text")


def prompt_context(text: Column, quote: Column, around: int = 600) -> Column:
    """The text around a quote's first place, so many characters on either side, white space collapsed; null if it isn't there."""
    return let(F.position(quote, text), lambda at: F.when(at > 0, collapsed(F.substr(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + F.char_length(quote) + around))))


def find_text(quote: Column, words: int = 6) -> Column:
    """What to search a page for: the first six words of a quote without marks at their ends."""
    plain = F.filter(F.transform(F.split(collapsed(quote), " "), lambda w: F.regexp_replace(w, r"^[\p{P}]+|[\p{P}]+$", "")), lambda w: w != "")
    return F.array_join(F.slice(plain, 1, words), " ")


def fitted_link(base: Column, note: Column, limit: int = 6000) -> Column:
    """A link with a note in its query, shortened word by word from the end until the encoded link fits."""
    words = F.split(collapsed(note), " ")
    sizes = F.transform(words, lambda w: F.char_length(F.url_encode(w)) + 1)
    upto = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), (F.char_length(base) + 10).alias("used")), lambda acc, s: F.when(acc["used"] + s <= limit, F.struct((acc["n"] + 1).alias("n"), (acc["used"] + s).alias("used"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(limit + 1).alias("used"))), lambda acc: acc["n"])
    return F.concat(base, F.url_encode(F.array_join(F.slice(words, 1, upto), " ")), F.when(upto < F.size(words), F.lit("%E2%80%A6")).otherwise(""))
