"""Quotes: capture, exact places and approximate ones.

Texts and quotes are compared without white space. A quote with at most k edits, cut into k + 1
pieces, holds one of them unchanged; so pieces found by plain search bound the stretches of a
text that can hold the quote. Most such pieces are there by chance. Two rules that lose no place tell them: one of the unchanged
pieces is the last or has half of its next piece behind it, and an edit changes four runs of four characters at most, so a
stretch with too few of the quote's runs can't hold it. Only the others are searched by Myers' bit-parallel edit distance.
"""

from __future__ import annotations


from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rule of approximate places.
CHARS_PER_EDIT, MOST_EDITS = 8, 256
SHORT_QUOTE, CONTEXT_AGREES = 32, 0.5
QUOTE_WEIGHT, CONTEXT_WEIGHT, POSITION_WEIGHT, EQUAL_SCORES = 50, 20, 2, 1e-9
CONTEXT_CHARS = 32

#: Characters of the runs that a stretch must share with a quote; CHARS_PER_EDIT is more, so every quote has to share some.
RUN = 4
#: Characters of quotes that travel to the executors at a time, and the number of such blocks from which long quotes meet the texts in a join.
BLOCK_CHARS, MOST_BLOCKS = 1_000_000, 4
#: Quotes of one text that are placed together.
QUOTES_A_ROW = 500


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


# Capture


def captures(selections: DataFrame) -> DataFrame:
    """Selections ``quote_id, text_id, text, start, length`` (code points of ``text``, from 0) as stored quotes.

    ``quote`` is the selection without white space; ``occurrence`` counts the quote's places before it, ``position`` is where it starts,
    ``prefix`` and ``suffix`` are the 32 characters around it. A selection of white space alone is no quote.
    """
    at, length = F.col("start").cast("int"), F.col("length").cast("int")
    parts = selections.select(
        "quote_id", "text_id", squashed(F.substr("text", at + 1, length)).alias("quote"),
        squashed(F.substr("text", F.lit(1), at)).alias("before"), squashed(F.substr("text", at + length + 1)).alias("after"),
    )
    left_out = F.char_length("before") - F.char_length(F.replace("before", "quote", F.lit("")))
    return parts.filter("quote <> ''").select(
        "quote_id", "text_id", "quote", (left_out / F.char_length("quote")).cast("int").alias("occurrence"), F.char_length("before").alias("position"),
        F.right("before", F.lit(CONTEXT_CHARS)).alias("prefix"), F.left("after", F.lit(CONTEXT_CHARS)).alias("suffix"),
    )


# Places in one text


def _ends(text: str, pattern: str, most: int) -> tuple[int, list[int]]:
    """The least edits, ``most`` at most, with which ``pattern`` ends somewhere in ``text``, and all those ends."""
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    every, last = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, edits, found = every, 0, len(pattern), []
    for at, c in enumerate(text, 1):
        same = where.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(across | up), up & across
        edits += bool(more & last) - bool(less & last)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | every & ~(vertical | more), more & vertical
        if edits <= most:
            if edits < most:
                most, found = edits, []
            found.append(at)
    return most, found


def _closest(text: str, pattern: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the closest stretches, each as long as its edits allow."""
    edits, ends = _ends(text, pattern, most)
    found = []
    for end in ends:
        back = text[max(0, end - len(pattern) - edits) : end][::-1]
        found.append((end - max(_ends(back, pattern[::-1], edits)[1], default=0), end, edits))
    return found


def _pieces(quote: str) -> list[tuple[int, str]]:
    """k + 1 pieces of a quote that may have k edits, with their places."""
    n = min(MOST_EDITS, len(quote) // CHARS_PER_EDIT) + 1
    cuts = [len(quote) * k // n for k in range(n + 1)]
    return [(a, quote[a:z]) for a, z in zip(cuts, cuts[1:])]


def _followed(quote: str) -> list[tuple[str, tuple[int, str, str]]]:
    """The pieces, each with where it ends and the halves of the next one.

    With k edits in k + 1 pieces, some piece begins a round of all pieces of which the first n have less than n edits for every n. So it
    is unchanged, and the next one has an edit at most: a half of it is unchanged, and stands at most one place off. Nothing is asked of what follows the last piece.
    """
    pieces = _pieces(quote)
    halves = [(p[: len(p) // 2], p[len(p) // 2 :]) for _, p in pieces[1:]] + [("", "")]
    return [(piece, (at + len(piece), *half)) for (at, piece), half in zip(pieces, halves)]


def _starts(text: str, ends: Iterable[tuple[int, tuple[int, str, str]]]) -> list[int]:
    """Where a quote would start of which pieces (see ``_followed``) end at ``ends``, without those that what stands behind them rules out."""
    out = []
    for end, (reach, first, second) in ends:
        behind = text[end : end + len(first) + len(second) + 1]
        if first in behind or second in behind:
            out.append(end - reach)
    return out


def _stretches(text: str, quote: str, hits: list[int]) -> list[tuple[int, int]]:
    """Where a quote may lie whose first character would be near each of ``hits``, joined where they overlap."""
    slack, out = min(MOST_EDITS, len(quote) // CHARS_PER_EDIT), []
    for hit in sorted(set(hits)):
        a, z = max(0, hit - slack), min(len(text), hit + len(quote) + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _runs(text: str) -> list[str]:
    return [text[k : k + RUN] for k in range(len(text) - RUN + 1)]


def _may_hold(text: str, quote: str, runs: set[str], most: int) -> bool:
    """Whether some part of ``text``, as long as ``quote`` with ``most`` edits can be, has so many of its ``runs`` as that many edits must leave. False only where no such place is."""
    least, length = len(quote) - RUN + 1 - RUN * most, len(quote) - RUN + 1 + most
    shared = [r in runs for r in _runs(text)]
    if sum(shared) < least:
        return False
    upto = [0, *accumulate(shared)]
    return len(shared) <= length or any(z - a >= least for a, z in zip(upto, upto[length:]))


def _places(text: str, piece: str) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _agreement(actual: str, expected: str) -> float | None:
    """How closely a text's context holds the stored one; None if nothing was stored."""
    if not expected:
        return None
    return 1 - _ends(actual, expected, len(expected))[0] / len(expected) if actual else 0.0


@dataclass(frozen=True)
class Place:
    start: int
    end: int
    edits: int


def approximate_place(text: str, quote: str, prefix: str = "", suffix: str = "", position: int | None = None, hits: list[int] | None = None) -> Place | None:
    """The closest stretch of ``text`` to ``quote``, an edit for each eight characters at most, or none.

    None if a quote below 32 characters has no context that agrees by half, or if two separate stretches
    score the same. ``hits`` are places at which pieces of the quote, if any is there, would let it start.
    """
    most = min(MOST_EDITS, len(quote) // CHARS_PER_EDIT)
    if most < 1 or not text:
        return None
    if hits is None:
        hits = _starts(text, ((at + len(piece), follow) for piece, follow in _followed(quote) for at in _places(text, piece)))
    found: list[tuple[int, int, int]] = []
    runs = set(_runs(quote)) if hits else set()
    for a, z in _stretches(text, quote, hits):
        if not _may_hold(text[a:z], quote, runs, most):
            continue
        new = [(a + s, a + e, edits) for s, e, edits in _closest(text[a:z], quote, most)]
        if new and new[0][2] < most:
            most, found = new[0][2], []
        found += new
    scored = []
    for start, end, edits in found:
        before = _agreement(text[max(0, start - len(prefix)) : start], prefix)
        after = _agreement(text[end : end + len(suffix)], suffix)
        if len(quote) < SHORT_QUOTE and max(before or 0, after or 0) < CONTEXT_AGREES:
            continue
        near = 1 if position is None else 1 - abs(start - position) / len(text)
        context = sum(CONTEXT_WEIGHT * (1 if a is None else a) for a in (before, after))
        scored.append((QUOTE_WEIGHT * (1 - edits / len(quote)) + context + POSITION_WEIGHT * near, start, end, edits))
    if not scored:
        return None
    best = max(scored, key=lambda s: s[0])
    apart = [s for s in scored if s[2] <= best[1] or s[1] >= best[2]]
    if any(best[0] - s[0] < EQUAL_SCORES for s in apart):
        return None
    return Place(*best[1:])


def exact_place(text: str, quote: str, occurrence: int, prefix: str, suffix: str) -> Place | None:
    """The stored occurrence of a quote, or else the one place whose context is the stored one."""
    starts, at = [], text.find(quote)
    while at >= 0:
        starts.append(at)
        at = text.find(quote, at + len(quote))
    if occurrence < len(starts):
        start = starts[occurrence]
    else:
        fit = [s for s in starts if text.endswith(prefix, 0, s) and text.startswith(suffix, s + len(quote))]
        if len(fit) != 1:
            return None
        start = fit[0]
    return Place(start, start + len(quote), 0)


def placed(notes: DataFrame, texts: DataFrame) -> DataFrame:
    """Where stored quotes lie in the texts that they belong to: ``quote_id, text_id, match, start, end, edits``.

    ``notes`` has ``quote_id, text_id, quote, occurrence, position, prefix, suffix`` (quote and context without white space), ``texts``
    has ``text_id, text``. ``match`` is exact, approximate, or null if the quote has no place; a note whose text is missing has none. Notes of a
    text meet it in blocks of QUOTES_A_ROW, so a text with many notes fills many rows and none is gathered whole.
    """
    fields = ["quote_id", "quote", "occurrence", "position", "prefix", "suffix"]
    nth = F.row_number().over(Window.partitionBy("text_id", F.pmod(F.xxhash64("quote_id"), F.lit(64))).orderBy("quote_id"))
    dealt = notes.withColumn("_part", F.pmod(F.xxhash64("quote_id"), F.lit(64))).withColumn("_row", F.floor((nth - 1) / QUOTES_A_ROW))
    blocks = dealt.groupBy("text_id", "_part", "_row").agg(F.collect_list(F.struct(*fields)).alias("notes"))
    rows = blocks.join(texts.select("text_id", squashed(F.col("text")).alias("plain")), "text_id", "left")
    types = {f.name: f.dataType.simpleString() for f in notes.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["quote_id", "text_id", "match", "start", "end", "edits"]
        for batch in batches:
            out: list[tuple] = []
            for text_id, text, block in zip(*(batch.column(c).to_pylist() for c in ("text_id", "plain", "notes"))):
                for note in block:
                    context = note["prefix"] or "", note["suffix"] or ""
                    found = text and note["quote"] and exact_place(text, note["quote"], note["occurrence"] or 0, *context)
                    kind = "exact" if found else "approximate"
                    found = found or text and note["quote"] and approximate_place(text, note["quote"], *context, note["position"])
                    out.append((note["quote_id"], text_id, *((kind, found.start, found.end, found.edits) if found else (None,) * 4)))
            kinds = [batch.schema.field("notes").type.value_type.field("quote_id").type, batch.schema.field("text_id").type, pa.string(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names)

    schema = f"quote_id {types['quote_id']}, text_id {types['text_id']}, match string, start int, end int, edits int"
    return rows.select("text_id", "plain", "notes").mapInArrow(place, schema)


# Quotes that may be in any text


def _blocks(quotes: DataFrame) -> list[DataFrame]:
    """``quotes`` in blocks of some BLOCK_CHARS characters; equal quotes stay in one."""
    n = max(1, -(-(quotes.agg(F.sum(F.char_length("quote"))).first()[0] or 0) // BLOCK_CHARS))
    return [quotes.filter(F.pmod(F.xxhash64("quote"), F.lit(n)) == k) for k in range(n)]


def _scanned(block: DataFrame, texts: DataFrame, keys: Callable, found: Callable, schema: str) -> DataFrame:
    """One pass over ``texts`` with all keys of a block's quotes; ``found(quote row, text, ends)`` gives the values of a row or None.

    ``keys(quote row)`` are (word, value) pairs; ``ends`` the (end, value) pairs of the words of this quote that the text holds.
    """
    spark, rows = texts.sparkSession, block.collect()  # of some BLOCK_CHARS characters
    words: dict[str, list[tuple]] = {}
    for k, row in enumerate(rows):
        for word, value in keys(row):
            words.setdefault(word, []).append((k, value))
    shared = spark.sparkContext.broadcast((rows, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words = shared.value
        automaton = ahocorasick.Automaton()
        for word, owners in words.items():
            automaton.add_word(word, owners)
        automaton.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for text_id, text in zip(*(batch.column(c).to_pylist() for c in ("text_id", "plain"))):
                ends: dict[int, list[tuple]] = {}
                for end, owners in automaton.iter(text or "") if words else ():
                    for k, value in owners:
                        ends.setdefault(k, []).append((end + 1, value))
                for k, places in ends.items():
                    values = found(rows[k], text, places)
                    if values is not None:
                        out.append((rows[k]["quote_id"], text_id, *values))
            frame = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(target), target.types)], schema=target)
            yield from frame.to_batches() or [pa.RecordBatch.from_arrays([pa.array([], t) for t in target.types], schema=target)]

    from pyspark.sql.pandas.types import to_arrow_schema

    result = spark.createDataFrame([], schema)
    target = to_arrow_schema(result.schema)
    return texts.select("text_id", squashed(F.col("text")).alias("plain")).mapInArrow(scan, schema)


def _ids(quotes: DataFrame, texts: DataFrame) -> str:
    return f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, text_id {texts.schema['text_id'].dataType.simpleString()}"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def anchors(quotes: DataFrame, texts: DataFrame, grams: int = 12) -> DataFrame:
    """Every text that holds a quote: ``quote_id, text_id, position, n`` (first place from 0, and how many places that don't overlap).

    ``quotes`` has ``quote_id, text``, ``texts`` has ``text_id, text``; white space is left out, empty quotes are nowhere. Texts are scanned where
    they lie with a block of quotes at a time. Long quotes that would fill more than MOST_BLOCKS blocks meet the texts in a join instead.
    """
    q = quotes.select("quote_id", squashed(F.col("text")).alias("quote")).filter("quote <> ''")
    schema = f"{_ids(quotes, texts)}, position int, n long"
    whole = _blocks(q)
    if len(whole) <= MOST_BLOCKS:
        return _union([_scanned(b, texts, _whole, _counted, schema) for b in whole])
    short, long = q.filter(F.char_length("quote") < 2 * grams), q.filter(F.char_length("quote") >= 2 * grams)
    return _union([*(_scanned(b, texts, _whole, _counted, schema) for b in _blocks(short)), _joined(long, texts, grams)])


def _whole(row) -> list[tuple[str, int]]:
    return [(row["quote"], 0)]


def _counted(row, text: str, ends: list[tuple[int, int]]) -> tuple[int, int]:
    return text.find(row["quote"]), text.count(row["quote"])


def _joined(q: DataFrame, texts: DataFrame, grams: int) -> DataFrame:
    """Exact places by an equi-join: a quote of twice ``grams`` characters covers a whole block of a text cut into such blocks."""
    starts = F.sequence(F.lit(1), F.char_length("quote") - grams + 1)
    runs = q.select("quote_id", F.explode(F.transform(starts, lambda k: F.substr("quote", k, F.lit(grams)))).alias("run")).distinct()
    t = texts.select("text_id", squashed(F.col("text")).alias("plain"))
    blocks = t.select("text_id", F.explode(F.regexp_extract_all("plain", F.lit(f"(?s).{{{grams}}}"), F.lit(0))).alias("run"))
    candidates = blocks.join(runs, "run").select("text_id", "quote_id").distinct()
    met = candidates.join(q, "quote_id").join(t, "text_id").filter(F.contains("plain", "quote"))
    n = (F.char_length("plain") - F.char_length(F.replace("plain", "quote", F.lit("")))) / F.char_length("quote")
    return met.select("quote_id", "text_id", (F.position("quote", "plain") - 1).alias("position"), n.cast("long").alias("n"))


def approximate_anchors(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Every text with an approximate place of a quote: ``quote_id, text_id, start, end, edits``.

    ``quotes`` has ``quote_id, text`` and may have ``prefix, suffix``. All pieces of a block of quotes are
    looked for in one pass over the texts, whatever their number, and places are as in ``approximate_place``.
    """
    context = [squashed(F.col(c) if c in quotes.columns else F.lit("")).alias(c) for c in ("prefix", "suffix")]
    q = quotes.select("quote_id", squashed(F.col("text")).alias("quote"), *context).filter(F.char_length("quote") >= CHARS_PER_EDIT)
    schema = f"{_ids(quotes, texts)}, start int, end int, edits int"

    def keys(row) -> list[tuple[str, tuple[int, str, str]]]:
        return _followed(row["quote"])

    def found(row, text: str, ends: list[tuple[int, tuple[int, str, str]]]) -> tuple[int, int, int] | None:
        hits = _starts(text, ends)
        place = hits and approximate_place(text, row["quote"], row["prefix"] or "", row["suffix"] or "", hits=hits)
        return (place.start, place.end, place.edits) if place else None

    return _union([_scanned(b, texts, keys, found, schema) for b in _blocks(q)])


