"""Lines that many documents share, found by hash and dropped through bitmaps.

A line's key is the line without white space (``\\x20``, ``\\x09`` to ``\\x0D``) at its ends, A-Z
lower-cased. Keys travel as 128-bit hashes with the document and the position; texts stay where
they are. The hashes are dealt out by ranges and sorted by document and position, so that one pass
over a range sees a key's documents one after another, with its first occurrence in each. A key
with many documents may fill several ranges: the runs at the ends of a range tell their counts,
and those are added up. What comes back is a compressed bitmap of kept lines for each document
that loses any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import ascii_lower, stored

WHITE = " \t\n\x0b\x0c\r"
#: Documents that must share a key, and code points that it must have.
LEAST_DOCS, LEAST_CHARS = 10, 1


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _with_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text, d1, d2``: a document is known by a hash of its doc_id and text, which no second reading can change."""
    own = [F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))]
    return docs.select("doc_id", "text", F.xxhash64(*own).alias("d1"), F.xxhash64(F.lit(1), *own).alias("d2"))


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``h1, h2, d1, d2, pos, n``: where each key stands; n is the number of equal rows (doc_id and text) that have it there."""
    lines = _with_key(docs).select("d1", "d2", F.posexplode(text_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    keys = lines.select("d1", "d2", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).filter(F.char_length("key") >= least_chars)
    hashed = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d1", "d2", "pos")
    return hashed.groupBy("h1", "h2", "d1", "d2", "pos").agg(F.count("*").alias("n"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


COLUMNS = ("h1", "h2", "d1", "d2", "pos", "n")


def _stream(least_docs: int):
    """A pass over sorted keys. Rows out: lines to drop (d1, d2, pos), lines of undecided end runs (all but n), counts of end runs (h1, h2, n)."""

    def out(n: np.ndarray | None = None, **columns: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(next(iter(columns.values()))), pa.int64())
        arrays = [pa.array(columns[c]) if c in columns else none for c in COLUMNS[:-1]]
        return pa.RecordBatch.from_arrays([*arrays, none if n is None else pa.array(n)], list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, np.int64) for c in COLUMNS}  # the last run so far, while it has too few documents
        known = first = None  # the last run's key once it has enough, the key of the range's first run

        def decide(rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, known, first
            starts = np.flatnonzero(_starts(rows["h1"], rows["h2"]))
            lengths = np.diff(np.append(starts, len(rows["h1"])))
            once = _starts(rows["h1"], rows["h2"], rows["d1"], rows["d2"])
            docs = np.add.reduceat(np.where(once, rows["n"], 0), starts)
            here, now = ((int(rows["h1"][k]), int(rows["h2"][k])) for k in starts[[0, -1]])
            if known == here:
                docs[0] = max(docs[0], least_docs)
            first = first or here
            many, over, end = docs >= least_docs, np.ones(len(starts), bool), np.zeros(len(starts), bool)
            over[-1] = last
            end[0] = here == first
            end[-1] |= last
            told, unsure = end & (many | over), np.repeat(end & over & ~many, lengths)
            yield out(**{c: rows[c][np.repeat(many, lengths)] for c in ("d1", "d2", "pos")})
            yield out(docs[told], h1=rows["h1"][starts[told]], h2=rows["h2"][starts[told]])
            yield out(**{c: rows[c][unsure] for c in COLUMNS[:-1]})
            known = now if many[-1] else None
            held = {c: v[len(v) if known or last else starts[-1] :] for c, v in rows.items()}

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS}
            if batch.num_rows:
                yield from decide({c: np.concatenate([held[c], new[c]]) for c in COLUMNS}, last=False)
        if known:
            yield out(np.array([least_docs]), h1=np.array(known[:1]), h2=np.array(known[1:]))
        elif len(held["h1"]):
            yield from decide(held, last=True)

    return run


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``d1, d2, n_dropped, keep`` of every document that loses lines.

    ``keep`` is a zlib-compressed bitmap, a set bit for each kept line up to the last dropped one;
    all lines beyond stay. Repeated rows count as documents of their own and share a bitmap, a null
    doc_id is a value like any other, a null text has one empty line, a text of any length is
    read whole, and other columns are ignored. No rows give no bitmaps.
    """
    keys = stored(line_keys(docs.select("doc_id", "text"), least_chars).withColumn("pos", F.col("pos").cast("long")))
    place = ["h1", "h2", "d1", "d2"]
    dealt = keys.repartitionByRange(*place).sortWithinPartitions(*place, "pos")
    found = stored(dealt.mapInArrow(_stream(least_docs), ", ".join(f"{c} long" for c in COLUMNS)))
    ends = found.filter("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least_docs)
    unsure = found.filter("n is null and h1 is not null").join(ends, ["h1", "h2"], "left_semi")
    lines = found.filter("h1 is null").select("d1", "d2", "pos").union(unsure.select("d1", "d2", "pos"))

    @F.pandas_udf("binary")
    def bitmap(dropped: pd.Series) -> pd.Series:
        def of(places: np.ndarray) -> bytes:
            bits = np.ones(int(places.max()) + 1, bool)
            bits[places] = False
            return zlib.compress(np.packbits(np.append(bits, np.ones(-len(bits) % 8, bool))).tobytes())

        return dropped.map(of)

    by_document = lines.groupBy("d1", "d2").agg(F.collect_set("pos").alias("dropped"))
    return by_document.select("d1", "d2", F.size("dropped").cast("long").alias("n_dropped"), bitmap("dropped").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """A text's lines that a bitmap keeps, joined by line feeds; all lines if there is no bitmap."""

    def of(value: str | None, packed: bytes | None) -> str:
        if packed is None:
            return value or ""
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
        return "\n".join(line for k, line in enumerate((value or "").split("\n")) if k >= len(bits) or bits[k])

    @F.pandas_udf("string")
    def kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([of(t, b) for t, b in zip(texts, bitmaps)], dtype=object)

    return kept(text, keep)


def without_common_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_dropped``, the text without lines that ``least_docs`` documents share.

    Cases are as in ``keep_bitmaps``; a text of which nothing stays is empty.
    """
    bitmaps = keep_bitmaps(docs, least_docs, least_chars)
    rows = _with_key(docs.select("doc_id", "text")).join(bitmaps, ["d1", "d2"], "left")
    n_lines = F.size(text_lines(F.col("text"))).cast("long").alias("n_lines")
    return rows.select("doc_id", kept_text(F.col("text"), F.col("keep")).alias("text"), n_lines, F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))
