"""Reading order of positioned text: runs to lines by baselines and gaps, columns by coverage, bands, blocks that go on across columns and pages.

Runs are ``doc, page, seq, text, x, y, w, h, baseline, size, bold, rotated``. Lines and columns are found in one array of lines for
each page, blocks in Arrow tables of whole documents, so a document's runs are shuffled once by page and its pages once by document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.functions.text import let
from papershed.operators.batches import edge, heaviest, matches, slices, starts, whole
from papershed.sources.folders import spread

# Tolerances of lines, columns and blocks, in shares of sizes and widths.
BASELINE, CELL_GAP, WORD_GAP, BOLD_SHARE = 0.4, 1.0, 0.25, 0.9
NARROW, NARROW_LEAST, LEAST_GAP, GAP_COVERAGE, GAP_LINES, COLUMN_COVERAGE, COLUMN_LINES, FULL_RATIO, CROSS_EMS, BINS, MAX_COLUMNS = 0.6, 0.25, 0.015, 0.15, 3, 0.05, 4, 1.6, 0.5, 200, 3
LEADING, SIZE_TOLERANCE, INDENT_EMS, SHORT_EMS, HEADING_RATIO, NUMBERED_RATIO, HEADING_WORDS, CONTINUING_CHARS = 1.6, 0.06, 1, 2, 1.15, 1.05, 12, 40
REPLACED, LONG_TOKENS, CHECKED_CHARS = 0.3, 15, 200
#: The end of a text, or a line separator there.
END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"
SENTENCE_END = r"[.!?。！？:][\s\x0b\"”’')\]]*" + END
HYPHEN = rf"[-‐]({END})"
NUMBERED = r"^(?:(\d+(?:\.\d+)*)\.?|[IVXLC]+\.?|[A-Z](?:\.\d+)*\.?)\s+[A-Z\d“\"(]"
CAPTION = r"(?i)^(Figure|Fig\.|Table|Algorithm|图|表)\s*(?:\d+|[IVX]+)(?:\.\d+)?[a-z]?\s*[:.．：]"
LIST_MARK = r"^(?:[•●○◦▪■–—\-*·]|\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)])\s+"


def degraded_pages(runs: DataFrame) -> DataFrame:
    """``doc, page`` of pages whose text is no use: none, over 30 percent replacement characters, or words of over 15 characters in the mean."""
    sums = runs.groupBy("doc", "page").agg(F.sum(F.char_length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("�"))).alias("bad"), F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("tokens"))
    return sums.filter((F.col("chars") == 0) | (F.col("bad") > REPLACED * F.col("chars")) | ((F.col("chars") >= CHECKED_CHARS) & (F.col("chars") > LONG_TOKENS * F.greatest("tokens", F.lit(1))))).select("doc", "page")


LINE = "array<struct<y: double, x: double, right: double, bottom: double, baseline: double, size: double, bold: boolean, text: string>>"


def _lines(runs: pa.Table) -> pa.RecordBatch:
    """The lines of whole pages of runs, an array for each page."""
    first = starts(runs, ("doc", "page"))
    page = np.repeat(np.arange(len(first)), np.diff(np.r_[first, runs.num_rows]))
    number = {c: runs.column(c).to_numpy() for c in ("seq", "x", "y", "w", "h", "baseline", "size", "bold")}
    larger = lambda v: np.maximum(v, np.r_[v[:1], v[:-1]])
    # Runs on one baseline
    order = np.lexsort((number["seq"], number["x"], number["baseline"], page))
    base, size = number["baseline"][order], number["size"][order]
    cluster = np.empty(len(order), np.int64)
    cluster[order] = np.cumsum(edge(page[order]) | (np.abs(np.diff(base, prepend=base[:1])) > BASELINE * larger(size)))
    # Cells of a line, from left to right: the farthest that runs before reach is found by ranks, so that it stays exact
    order = np.lexsort((number["seq"], number["x"], cluster))
    v = {c: a[order] for c, a in number.items()} | {"page": page[order]}
    right, new = v["x"] + v["w"], edge(cluster[order])
    by_right = np.argsort(right, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[by_right] = np.arange(len(order))
    reach = right[by_right[np.maximum.accumulate(np.cumsum(new) * len(order) + rank) % len(order)]]
    gap = v["x"] - np.r_[reach[:1], reach[:-1]]
    cut = new | (gap > CELL_GAP * larger(v["size"]))
    at, cell = np.flatnonzero(cut), np.cumsum(cut) - 1
    # What a line is
    text = runs.column("text").combine_chunks().take(pa.array(order))
    chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    parts = pc.binary_join_element_wise(pa.array(np.where(~new & (gap > WORD_GAP * v["size"]), " ", "")), text, "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(order)], pa.int32()), parts), "")
    joined = pc.utf8_trim(pc.replace_substring_regex(joined, "[ \\t\\n\\x0b\\f\\r]+", " "), " ")
    of_cell = heaviest(cell, v["size"], chars)
    bold = np.add.reduceat(np.where(v["bold"].astype(bool), chars, 0), at) >= BOLD_SHARE * np.add.reduceat(chars, at)
    line = {
        "y": np.minimum.reduceat(v["y"], at), "x": np.minimum.reduceat(v["x"], at), "right": np.maximum.reduceat(right, at), "bottom": np.maximum.reduceat(v["y"] + v["h"], at),
        "baseline": v["baseline"][at], "size": of_cell, "bold": bold,
    }
    down = np.lexsort((*reversed(list(line.values())), v["page"][at]))
    fields = [pa.array(a[down]) for a in line.values()] + [joined.take(pa.array(down))]
    ends = np.r_[np.flatnonzero(edge(v["page"][at][down])), len(down)]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, [*line, "text"]))
    own = pa.array(first)
    return pa.RecordBatch.from_arrays([*(runs.column(c).combine_chunks().take(own) for c in ("doc", "page")), lists], ["doc", "page", "l"])


def page_lines(runs: DataFrame, together: bool = False) -> DataFrame:
    """``doc, page, l``: the lines of each page, top down (fields of LINE): runs whose baselines are within 0.4 of their size, cut where a gap is wider than a cell's.

    Runs are dealt by page, unless those of a page lie ``together`` already, one after the other. A task holds the runs of a batch and of one page. Positions aren't null.
    """
    upright = runs.filter("not rotated and trim(text) <> ''").select("doc", "page", "seq", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "baseline", "size")], F.coalesce("bold", F.lit(False)).alias("bold"))
    dealt = upright if together else upright.repartition("doc", "page").sortWithinPartitions("doc", "page")

    kind = {c: runs.schema[c].dataType.simpleString() for c in ("doc", "page")}
    return dealt.mapInArrow(lambda batches: whole(batches, ("doc", "page"), _lines), f"doc {kind['doc']}, page {kind['page']}, l {LINE}")


def lines(runs: DataFrame, together: bool = False) -> DataFrame:
    """``doc, page, text, x, y, right, bottom, baseline, size, bold``: the lines of ``page_lines``, a row each."""
    return page_lines(runs, together).select("doc", "page", F.inline("l")).select("doc", "page", "text", "x", "y", "right", "bottom", "baseline", "size", "bold")


def pages_of(rows: DataFrame, width: float) -> DataFrame:
    """``doc, page, l, gaps, left, right, columns``: the lines of a page, top down, and the gaps between its columns.

    A gap is a run of 1/200 parts of the text's width that narrow lines hardly cover, with parts that they cover well on both sides;
    the two widest count. Rows are lines or, with ``l``, the pages of ``page_lines``.
    """
    line = F.struct("y", "x", "right", "bottom", "baseline", "size", "bold", "text")
    grouped = rows if "l" in rows.columns else rows.groupBy("doc", "page").agg(F.array_sort(F.collect_list(line)).alias("l"))
    grouped = grouped.withColumn("left", F.array_min(F.transform("l", lambda e: e["x"]))).withColumn("right", F.array_max(F.transform("l", lambda e: e["right"])))
    text_width = F.col("right") - F.col("left")
    w = lambda e: e["right"] - e["x"]
    h = lambda e: e["bottom"] - e["y"]
    narrow = F.filter("l", lambda e: w(e).between(NARROW_LEAST * text_width, NARROW * text_width))
    sized = grouped.withColumn("n", narrow).withColumn("bin", text_width / BINS)
    height = F.array_max(F.transform("n", lambda e: e["bottom"])) - F.array_min(F.transform("n", lambda e: e["y"]))
    median = F.get(F.array_sort(F.transform("n", h)), F.floor(F.size("n") / 2).cast("int"))
    first = lambda e: F.greatest(F.lit(0.0), F.round((e["x"] - F.col("left")) / F.col("bin")))
    last = lambda e: F.least(F.lit(BINS - 1.0), F.round((e["right"] - F.col("left")) / F.col("bin")) - 1)
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    spans = F.transform("n", lambda e: F.struct(first(e).alias("first"), last(e).alias("last"), h(e).alias("h")))

    def covered(spans: Column) -> Column:
        """The height over each bin; lines of one extent are summed before bins are looked at."""
        extents = F.array_distinct(F.transform(spans, lambda e: F.struct(e["first"], e["last"])))
        heights = F.transform(extents, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.aggregate(spans, F.lit(0.0), lambda acc, e: acc + F.when((e["first"] == x["first"]) & (e["last"] == x["last"]), e["h"]).otherwise(0.0)).alias("h")))
        return let(heights, lambda known: F.transform(bins, lambda b: F.aggregate(known, F.lit(0.0), lambda acc, e: acc + F.when((b >= e["first"]) & (b <= e["last"]), e["h"]).otherwise(0.0))))

    measured = sized.withColumn("height", height).withColumn("median", median).withColumn("coverage", let(spans, covered))
    is_gap = F.transform("coverage", lambda v: v <= F.least(GAP_COVERAGE * F.col("height"), GAP_LINES * F.col("median")))
    dense = F.transform("coverage", lambda v: v >= F.greatest(COLUMN_COVERAGE * F.col("height"), COLUMN_LINES * F.col("median")))
    flagged = measured.withColumn("gap", is_gap).withColumn("dense", dense)
    starts = F.filter(bins, lambda b: F.get("gap", b) & ((b == 0) | ~F.coalesce(F.get("gap", b - 1), F.lit(False))))
    ends = F.filter(bins, lambda b: F.get("gap", b) & ((b == BINS - 1) | ~F.coalesce(F.get("gap", b + 1), F.lit(False))))
    runs = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    wide = F.filter(runs, lambda r: (r["s"] > 0) & (r["e"] < BINS - 1) & ((r["e"] - r["s"] + 1) * F.col("bin") >= LEAST_GAP * width) & F.exists(F.slice("dense", F.lit(1), r["s"]), lambda d: d) & F.exists(F.slice("dense", r["e"] + 2, F.lit(BINS)), lambda d: d))
    widest = F.slice(F.reverse(F.array_sort(F.transform(wide, lambda r: F.struct((r["e"] - r["s"]).alias("wide"), (-r["s"]).alias("first"), r["s"].alias("s"), r["e"].alias("e"))))), 1, MAX_COLUMNS - 1)
    places = F.array_sort(F.transform(widest, lambda r: F.struct((F.col("left") + r["s"] * F.col("bin")).alias("start"), (F.col("left") + (r["e"] + 1) * F.col("bin")).alias("stop"))))
    none = F.array().cast("array<struct<start:double,stop:double>>")
    found = flagged.withColumn("gaps", F.when((F.size("n") >= 4) & (F.col("height") > 0), places).otherwise(none))
    return found.select("doc", "page", "l", "left", "right", "gaps", (F.size("gaps") + 1).alias("columns"))


PLACED = "doc {doc}, page {page}, columns int, page_left double, page_right double, column int, y double, x double, right double, bottom double, baseline double, size double, bold boolean, text string, band long, nth int"


def _placed(pages: pa.Table) -> pa.RecordBatch:
    """The lines of pages in reading order, a row each."""
    lists, gaps = (pages.column(c).combine_chunks() for c in ("l", "gaps"))
    page = np.repeat(np.arange(pages.num_rows), pc.list_value_length(lists).to_numpy())
    values = lists.flatten()
    x, right, size = (values.field(c).to_numpy() for c in ("x", "right", "size"))
    # The gaps of a page side by side, and the edges of its columns
    n_gaps = pc.list_value_length(gaps).to_numpy()
    of, nth_gap = np.repeat(np.arange(pages.num_rows), n_gaps), np.arange(n_gaps.sum()) - np.repeat(np.cumsum(n_gaps) - n_gaps, n_gaps)
    start, stop = np.full((2, pages.num_rows, n_gaps.max(initial=0)), np.nan)
    start[of, nth_gap], stop[of, nth_gap] = (gaps.flatten().field(c).to_numpy() for c in ("start", "stop"))
    lefts, rights = np.c_[pages.column("left").to_numpy(), stop], np.c_[start, np.full(pages.num_rows, np.nan)]
    rights[np.arange(pages.num_rows), n_gaps] = pages.column("right").to_numpy()
    # Lines that cross a gap, sit in one, or are far wider than their column
    centre, em = ((x + right) / 2)[:, None], (CROSS_EMS * size)[:, None]
    start, stop = start[page], stop[page]
    full = (((x[:, None] < start - em) & (right[:, None] > stop + em)) | ((centre > start) & (centre < stop))).any(1)
    at = (centre >= stop).sum(1)
    column = np.where(full | (right - x > FULL_RATIO * (rights[page, at] - lefts[page, at])), -1, np.minimum(at, pages.column("columns").to_numpy()[page] - 1))
    band = np.cumsum(edge(page) | edge(column == -1))
    order = np.lexsort((column, band, page))
    first = np.flatnonzero(edge(page))[np.cumsum(edge(page)) - 1]
    own, values = pa.array(page), values.take(pa.array(order))
    kept = {c: pages.column(c).combine_chunks().take(own) for c in ("doc", "page", "columns", "left", "right")}
    kept = {{"left": "page_left", "right": "page_right"}.get(c, c): a for c, a in kept.items()} | {"column": pa.array(column[order], pa.int32())}
    kept |= {c: values.field(c) for c in ("y", "x", "right", "bottom", "baseline", "size", "bold", "text")}
    return pa.RecordBatch.from_pydict(kept | {"band": pa.array((band - band[first] + 1)[order]), "nth": pa.array(np.arange(len(page)) - first + 1, pa.int32())})


def placed_lines(pages: DataFrame) -> DataFrame:
    """Lines in reading order, ``doc, page, nth, column`` and the line: bands top down, in a band the left column first; column -1 is full width.

    A line is full width if it crosses a gap, sits in one, or is far wider than its column. A band is a run of full-width lines
    or of column lines. Pages stay where they are.
    """
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("doc", "page")}
    return pages.mapInArrow(lambda batches: (_placed(pa.Table.from_batches([b])) for b in slices(batches)), PLACED.format(**kind))


def dominant_columns(pages: DataFrame, least_lines: int = 8) -> DataFrame:
    """``doc, columns``: the column count of most pages with eight lines or more, the larger of equals; 1 if no page has. Pages have their lines or ``n_lines``."""
    counted = pages.withColumn("counts", (F.col("n_lines") if "n_lines" in pages.columns else F.size("l")) >= least_lines).groupBy("doc", "columns").agg(F.count_if("counts").alias("n"))
    best = counted.groupBy("doc").agg(F.max_by("columns", F.struct("n", "columns")).alias("columns"), F.max("n").alias("most"))
    return best.select("doc", F.when(F.col("most") > 0, F.col("columns")).otherwise(1).alias("columns"))


def _glued(text: pa.Array, at: np.ndarray) -> pa.Array:
    """Texts from each place on as one: a hyphen at a line's end goes where a small letter follows, and joins without a space elsewhere."""
    ends = np.r_[at[1:], len(text)]
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    hyphen = inner & matches(text, HYPHEN)
    gone = hyphen.copy()
    gone[hyphen] = matches(text.take(pa.array(np.flatnonzero(hyphen) + 1)), r"^\p{Ll}")
    mask = pa.array(gone)
    parts = pc.replace_with_mask(text, mask, pc.replace_substring_regex(text.filter(mask), HYPHEN, r"\1"))
    parts = pc.binary_join_element_wise(parts, pa.array(np.where(inner & ~hyphen, " ", "")), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(text)], pa.int32()), parts), "")


def _words(text: pa.Array) -> np.ndarray:
    return pc.count_substring(text, " ").to_numpy().astype(np.int64) + 1


def _chars(text: pa.Array) -> np.ndarray:
    return pc.utf8_length(text).to_numpy().astype(np.int64)


def _captions(text: pa.Array) -> np.ndarray:
    """CAPTION ignores the case of A to Z alone, Arrow's that of all letters, so what it finds is looked at again."""
    found = matches(text, CAPTION)
    found[found] = [re.search(CAPTION, t, re.ASCII) is not None for t in text.filter(pa.array(found)).to_pylist()]
    return found


def _depth(text: str) -> int:
    dotted = (re.match(NUMBERED, text, re.ASCII) or [None, None])[1]
    return min(dotted.count(".") + 1, 3) if dotted else 2


def _blocks(rows: pa.Table) -> pa.RecordBatch:
    """The blocks of whole documents' lines in reading order."""
    doc, page = (np.repeat(np.arange(len(at)), np.diff(np.r_[at, rows.num_rows])) for at in (starts(rows, ("doc",)), starts(rows, ("doc", "page"))))
    x, right, baseline, size, column, band, columns = (rows.column(c).to_numpy() for c in ("x", "right", "baseline", "size", "column", "band", "columns"))
    bold, text = rows.column("bold").to_numpy().astype(bool), rows.column("text").combine_chunks()
    # A document's body size, and the sides of a page's column
    body = heaviest(doc, np.floor(size * 2 + 0.5) / 2, _chars(text))
    order = np.lexsort((column, page))
    sides = np.flatnonzero(edge(page[order]) | edge(column[order]))
    side = np.empty(len(order), np.int64)
    side[order] = np.repeat(np.arange(len(sides)), np.diff(np.r_[sides, len(order)]))
    l_left, l_right = np.minimum.reduceat(x[order], sides)[side], np.maximum.reduceat(right[order], sides)[side]
    # Pieces: where a line starts anew
    before = lambda a: np.r_[a[:1], a[:-1]]
    close = lambda a, b: np.abs(a - b) <= SIZE_TOLERANCE * np.maximum(a, b)
    same_place = ~(edge(page) | edge(column) | edge(band))
    indented = x - l_left >= INDENT_EMS * size
    short = before(right) < l_right - SHORT_EMS * before(size)
    set_apart = (baseline - before(baseline) > LEADING * np.maximum(size, before(size))) | ~close(size, before(size)) | edge(bold) | matches(text, LIST_MARK)
    plain = ~before(bold) & (before(size) < NUMBERED_RATIO * body[doc])
    new = ~same_place | set_apart | (plain & before(matches(text, SENTENCE_END)) & ((indented & (x - before(x) >= INDENT_EMS * size)) | short))
    at, line = np.flatnonzero(new), np.cumsum(new) - 1
    ends = np.r_[at[1:], len(new)]
    # What a piece is, and whether it goes on with the one before
    text, doc, n_lines, indented, full_last = _glued(text, at), doc[at], ends - at, indented[at], (right >= l_right - SHORT_EMS * size)[ends - 1]
    size, bold, body, own = np.maximum.reduceat(size, at), np.logical_and.reduceat(bold, at), body[doc], at
    words, chars = _words(text), _chars(text)
    first = edge(doc)
    follows = np.r_[~first[1:], False] & (np.abs(np.r_[size[1:], 0] - body) <= 0.12 * body)
    numbered = (words <= HEADING_WORDS) & (size >= NUMBERED_RATIO * body) & matches(text, NUMBERED)
    item = matches(text, LIST_MARK)
    heading = ~item & (n_lines <= 2) & (chars <= 200) & ((size >= HEADING_RATIO * body) | numbered | (bold & (words <= HEADING_WORDS) & follows & ~matches(text, r"\." + END)))
    kind = np.select([_captions(text), item, heading], ["caption", "item", "heading"], "paragraph")
    prose = kind == "paragraph"
    goes_on = ~first & prose & before(prose) & ~before(matches(text, SENTENCE_END)) & before(full_last) & ~indented & close(size, before(size)) & (before(n_lines > 1) | before(chars >= CONTINUING_CHARS))
    at, piece = np.flatnonzero(~goes_on), np.cumsum(~goes_on) - 1
    # Blocks, with the pages that begin in each
    text, kind, doc, first = _glued(text, at), kind[at], doc[at], edge(doc[at])
    opens = np.flatnonzero(edge(page))
    begun = pa.StructArray.from_arrays(
        [rows.column("page").combine_chunks().take(pa.array(opens)), pa.array(columns[opens]), pa.array(np.diff(np.r_[opens, len(page)]))], ["page", "columns", "n_lines"]
    )
    in_blocks = np.searchsorted(piece[line[opens]], np.arange(len(at) + 1))
    said = kind == "caption"
    depth = np.zeros(len(at), np.int32)
    heads = np.flatnonzero(kind == "heading")
    depth[heads] = [_depth(t) for t in text.take(pa.array(heads)).to_pylist()]
    own = pa.array(own[at])
    return pa.RecordBatch.from_pydict({
        "doc": rows.column("doc").combine_chunks().take(own), "block": pa.array(np.arange(len(at)) - np.flatnonzero(first)[doc] + 1), "page": rows.column("page").combine_chunks().take(own),
        "kind": pa.array(kind), "depth": pa.array(depth, mask=depth == 0), "text": text, "size": pa.array(np.maximum.reduceat(size, at)), "bold": pa.array(np.logical_and.reduceat(bold, at)),
        "n_lines": pa.array(np.add.reduceat(n_lines, at)), "n_pieces": pa.array(np.diff(np.r_[at, len(piece)])), "words": pa.array(_words(text)),
        "beside_caption": pa.array((~first & before(said)) | np.r_[said[1:] & ~first[1:], False]), "begun": pa.ListArray.from_arrays(pa.array(in_blocks, pa.int32()), begun),
    })


def blocks(rows: DataFrame) -> DataFrame:
    """``doc, block, page, kind, depth, text, size, bold, n_lines, n_pieces, words, beside_caption, begun``: paragraphs, list items and headings in
    reading order, paragraphs that stop in the middle of a sentence at a column's or page's foot joined with what goes on.

    A paragraph starts at a wide leading, another size or weight, a list mark, an indent or after a short line that ends a sentence, and in
    another column or page. A heading is set 1.15 times the body's size, or numbered and 1.05 times, or bold, short and without a full stop.
    ``begun`` are the pages that begin in the block, with their columns and numbers of lines.

    Rows are those of ``placed_lines`` or, with ``l``, of ``pages_of``, which are placed on the way. They are dealt by document and sorted once;
    a task holds the lines of a few hundred rows and of one document.
    """
    placed = "l" not in rows.columns
    read = ["doc", "page", *(["nth", "columns", "column", "band", "x", "right", "baseline", "size", "bold", "text"] if placed else ["l", "gaps", "left", "right", "columns"])]
    dealt = spread(rows.select(*read), "doc", times=16).sortWithinPartitions("doc", "page", *(["nth"] if placed else []))
    made = _blocks if placed else lambda pages: _blocks(pa.Table.from_batches([_placed(pages)]))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc", "page")}
    schema = "doc {doc}, block long, page {page}, kind string, depth int, text string, size double, bold boolean, n_lines long, n_pieces long, words long, beside_caption boolean, begun array<struct<page: {page}, columns: int, n_lines: long>>"
    return dealt.mapInArrow(lambda batches: whole(batches if placed else slices(batches), ("doc",), made), schema.format(**kind))


def certain(blocks_: DataFrame, words: int = 25) -> DataFrame:
    """Blocks with ``certain``: long prose between prose needs no judge; headings, short blocks and those beside captions do."""
    return blocks_.withColumn("certain", (F.col("kind") == "paragraph") & (F.col("words") >= words) & ~F.col("beside_caption"))


def judged(blocks_: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blocks after a judge's verdicts ``doc, block, kind, confidence``: a kind of 0.75 or more counts for uncertain blocks; a heading of over 25 words stays prose, furniture goes if it is short."""
    v = verdicts.select("doc", "block", F.col("kind").alias("said"), "confidence")
    n = F.col("words")
    sure = (F.col("confidence") >= 0.75) & ~F.col("certain") & ~((F.col("said") == "heading") & (n > 25)) & ~((F.col("said") == "furniture") & (n > 12))
    both = blocks_.join(v, ["doc", "block"], "left").withColumn("kind", F.when(F.coalesce(sure, F.lit(False)), F.col("said")).otherwise(F.col("kind")))
    return both.filter("kind <> 'furniture'").drop("said", "confidence")


def report(blocks_: DataFrame, pages: DataFrame, degraded: DataFrame) -> DataFrame:
    """``doc, pages, columns, degraded, headings, paragraphs, items, captions, joined``: what became of a document."""
    counts = blocks_.groupBy("doc").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("heading", "paragraph", "item", "caption")], F.sum(F.col("n_pieces") - 1).alias("joined"))
    n = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    bad = degraded.groupBy("doc").agg(F.count("*").alias("degraded"))
    return n.join(dominant_columns(pages), "doc").join(bad, "doc", "left").join(counts, "doc", "left").na.fill(0)
