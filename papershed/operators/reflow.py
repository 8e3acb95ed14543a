"""Page reflow on positioned text: runs to lines, furniture, columns, blocks, anchors.

Furniture and blocks are found in Arrow tables of whole documents, whose lines are dealt and sorted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papershed.operators.batches import edge, heaviest, starts, whole
from papershed.sources.folders import spread

PAGE_LINES, LINE_WORDS = 40, 8


def runs_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One run for each word of a document on a grid, with a running head and page numbers; the runs of a page lie together.

    ``doc, page, seq, text, x, y, size``; y grows downwards, from 0 to 1 on each page. Splitting can leave an empty first or last part.
    """
    per_page = PAGE_LINES * LINE_WORDS
    parts = docs.select("doc_id", F.split(F.trim("text"), r"\s+").alias("w"))
    first = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    last = F.size("w") - 1 - F.when(F.get("w", F.size("w") - 1) == "", 1).otherwise(0)
    some = parts.select(F.col("doc_id").alias("doc"), "w", first.alias("first"), last.alias("last")).filter("last >= first")
    pages = some.select("doc", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / per_page).cast("int"))).alias("page"), "w")
    shown = pages.select("doc", "page", F.posexplode(F.concat(F.array(F.lit("Head"), F.col("page").cast("string")), F.slice("w", F.col("page") * per_page + 1, F.lit(per_page)))).alias("k", "text"))
    # Place 0 is the head, place 1 the number, then come the words
    at, head, number = F.col("k") - 2, F.col("k") == 0, F.col("k") == 1
    line = F.floor(at / LINE_WORDS).cast("int")
    by = lambda of_head, of_number, of_word: F.when(head, of_head).when(number, of_number).otherwise(of_word)
    return shown.filter((F.col("k") < 2) | (F.col("text") != "")).select(
        "doc", "page", by(-2, -1, F.col("page") * per_page + at).alias("seq"), "text", by(0, 4, at % LINE_WORDS).alias("x"), by(0, PAGE_LINES + 3, line + 2).alias("y"),
        by(8.0, 8.0, F.when(line % 10 == 0, 14.0).otherwise(10.0)).alias("size"),
    )


def _lines(runs: pa.Table) -> pa.RecordBatch:
    """The lines of whole pages of runs."""
    first = starts(runs, ("doc", "page"))
    page = np.repeat(np.arange(len(first)), np.diff(np.r_[first, runs.num_rows]))
    x, y, seq, size = (runs.column(c).to_numpy() for c in ("x", "y", "seq", "size"))
    order = np.lexsort((seq, x, y, page))
    text, y, size = runs.column("text").combine_chunks().take(pa.array(order)), y[order], size[order]
    new = edge(page[order]) | edge(y)
    at, line = np.flatnonzero(new), np.cumsum(new) - 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(order)], pa.int32()), text), " ")
    chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    sizes = heaviest(line, size, chars)
    own = pa.array(order[at])
    kept = [runs.column(c).combine_chunks().take(own) for c in ("doc", "page", "y")]
    return pa.RecordBatch.from_arrays([*kept, pa.array(sizes, runs.schema.field("size").type), joined], ["doc", "page", "y", "size", "text"])


def lines(runs: DataFrame, together: bool = False) -> DataFrame:
    """Runs on one baseline joined from left to right; the size is the one with most characters.

    Runs are dealt by document, unless those of a page lie ``together`` already, one after the other. A task holds the runs of a batch and of one page. Texts and positions aren't null.
    """
    rows = runs.select("doc", "page", "seq", "text", "x", "y", "size")
    dealt = rows if together else rows.repartition("doc").sortWithinPartitions("doc", "page")
    kind = {c: runs.schema[c].dataType.simpleString() for c in ("doc", "page", "y", "size")}
    return dealt.mapInArrow(lambda batches: whole(batches, ("doc", "page"), _lines), ", ".join([*(f"{c} {t}" for c, t in kind.items()), "text string"]))


def _by_doc(rows: DataFrame) -> DataFrame:
    """The lines of a document in one task, one after the other from its top to its end."""
    return spread(rows, "doc", times=16).sortWithinPartitions("doc", "page", "y", "text")


def _masked(dealt: DataFrame) -> DataFrame:
    return dealt.withColumn("masked", F.regexp_replace(F.lower("text"), r"\d+", "#"))


def _number(rows: pa.Table, *columns: str) -> np.ndarray:
    """0, 1, 2, ... for the rows that agree in the columns and follow each other."""
    at = starts(rows, columns)
    return np.repeat(np.arange(len(at)), np.diff(np.r_[at, rows.num_rows]))


def _repeats(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of whole documents by key (doc, y, masked): their order, where keys begin in it, on how many pages each is, and whether these are enough."""
    doc, page = _number(rows, "doc"), _number(rows, "doc", "page")
    y, masked = rows.column("y").to_numpy(), rows.column("masked").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((page, masked, y, doc))
    new = edge(doc[order]) | edge(y[order]) | edge(masked[order])
    at = np.flatnonzero(new)
    n = np.add.reduceat((new | edge(page[order])).astype(np.int64), at)
    pages = np.add.reduceat(edge(page).astype(np.int64), np.flatnonzero(edge(doc)))
    enough = np.minimum(3, np.maximum(2, -(-pages // 2)))
    known = rows.column("doc").is_valid().to_numpy()[order[at]]
    return order, at, n, known & (n >= enough[doc[order[at]]])


def _furniture(rows: pa.Table) -> pa.RecordBatch:
    order, at, n, found = _repeats(rows)
    own = pa.array(order[at][found])
    return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(own) for c in ("doc", "y", "masked")), pa.array(n[found])], ["doc", "y", "masked", "n"])


def furniture(rows: DataFrame) -> DataFrame:
    """Keys (doc, y, masked text) that repeat on enough pages: min(3, max(2, half of the pages, rounded up))."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc", "y")}
    dealt = _masked(_by_doc(rows.select("doc", "page", "y", "text"))).drop("text")
    return dealt.mapInArrow(lambda batches: whole(batches, ("doc",), _furniture), "doc {doc}, y {y}, masked string, n long".format(**kind))


def without_furniture(rows: DataFrame) -> DataFrame:
    """The other lines; those of a document come together and in order."""
    names = rows.columns

    def others(table: pa.Table) -> pa.RecordBatch:
        order, at, _, found = _repeats(table)
        keep = np.empty(len(order), bool)
        keep[order] = np.repeat(~found, np.diff(np.r_[at, len(order)]))
        left = table.filter(pa.array(keep))
        return pa.RecordBatch.from_arrays([left.column(c).combine_chunks() for c in names], names)

    return _masked(_by_doc(rows)).mapInArrow(lambda batches: whole(batches, ("doc",), others), rows.schema)


def body_size(rows: DataFrame) -> DataFrame:
    """A document's size by weight of text, to the nearest half; the larger of two equal ones."""
    rounded = rows.withColumn("size", F.floor(F.col("size") * 2 + 0.5) / 2)
    weights = rounded.groupBy("doc", "size").agg(F.sum(F.char_length("text")).alias("weight"))
    return weights.groupBy("doc").agg(F.max_by("size", F.struct("weight", "size")).alias("body_size"))


def _blocks(rows: pa.Table) -> pa.RecordBatch:
    """The blocks of whole documents' lines."""
    doc, size, text = _number(rows, "doc"), rows.column("size").to_numpy(), rows.column("text").combine_chunks()
    chars = pc.utf8_length(text).to_numpy().astype(np.int64)
    heading = size >= 1.15 * heaviest(doc, np.floor(size * 2 + 0.5) / 2, chars)[doc]
    at = np.flatnonzero(edge(doc) | heading | np.r_[False, heading[:-1]])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)], pa.int32()), text), " ")
    # A block's place among its document's, and the characters before it with two for each break
    first = np.flatnonzero(edge(doc[at]))[doc[at]]
    before = np.cumsum(np.r_[0, pc.utf8_length(joined).to_numpy().astype(np.int64)[:-1] + 2])
    own = pa.array(at)
    return pa.RecordBatch.from_arrays([
        rows.column("doc").combine_chunks().take(own), pa.array(np.arange(len(at)) - first + 1), pa.array(heading[at]), rows.column("page").combine_chunks().take(own), joined, pa.array(before - before[first]),
    ], ["doc", "block", "heading", "page", "text", "start"])


def blocks(rows: DataFrame, together: bool = False) -> DataFrame:
    """Headings (1.15 times the body size or more) and paragraphs of the lines between them, with text offsets.

    ``start`` is where a block begins in the document's plain text, blocks joined by a blank line. Lines are dealt by document, unless
    those of a document lie ``together`` in order already, as ``without_furniture`` leaves them. A null document has no blocks.
    """
    lines_ = rows.filter("doc is not null").select("doc", "page", "y", "size", "text")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc", "page")}
    schema = "doc {doc}, block long, heading boolean, page {page}, text string, start long".format(**kind)
    return (lines_ if together else _by_doc(lines_)).mapInArrow(lambda batches: whole(batches, ("doc",), _blocks), schema)
