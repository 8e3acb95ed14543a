"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the n-grams that are common in it. The filters lie side by
side: entry i of one array holds bit i of every filter, one bit for each language, so ANDing
the entries of an n-gram's positions gives the mask of all languages that contain it. A text's
n-grams are counted per language by popcounts, the counts lose what false positives add, and
the language with most wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import stored

UNDETERMINED = "und"
SIZES = (3, 4)
#: Bound of the fit: documents of a language (expected, by a hash of the text).
DOCS_PER_LANGUAGE = 2000
#: An n-gram enters a language's filter if at least so often there, and if its rate is at least this share of its highest rate.
LEAST_COUNT, LEAST_SHARE = 5, 0.25
#: A filter has 16 slots for each n-gram of the language that has most, as a power of two, but no fewer than this.
LEAST_SLOTS, HASHES = 1 << 20, 4
SHARPNESS = 12

_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Lower case, with one space for whatever isn't a letter."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: str) -> np.ndarray:
    """64-bit hashes of all n-grams of a normal text, word ends included."""
    points = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    found = []
    for n in SIZES:
        if len(points) < n:
            continue
        h = points[: len(points) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
        found.append(_mix(h))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _positions(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Filters:
    """``tables``: the bit slices, 64 languages a table; ``rates``: each language's share of false positives; ``usual``: the commonest language."""

    languages: list[str] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    usual: int = 0

    @staticmethod
    def of(languages: list[str], grams: list[np.ndarray], usual: int) -> Filters:
        slots = max(LEAST_SLOTS, 1 << int(16 * max(map(len, grams), default=0)).bit_length())
        tables, rates = [], []
        for first in range(0, len(languages), 64):
            some = grams[first : first + 64]
            wide = next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(d).itemsize * 8 >= len(some))
            table = np.zeros(slots, wide)
            for bit, h in enumerate(some):
                for at in _positions(h, slots):
                    table[np.unique(at)] |= wide(1 << bit)
            tables.append(table)
            rates += [float(((table >> wide(b)) & wide(1)).mean()) for b in range(len(some))]
        return Filters(languages, tables, np.array(rates) ** HASHES, usual)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """How many of the hashes each language's filter has, false positives included."""
        found: list[float] = []
        for k, table in enumerate(self.tables):
            masks = None
            for at in _positions(h, len(table)):
                masks = table[at] if masks is None else masks & table[at]
            n, kind = min(64, len(self.languages) - 64 * k), table.dtype.type
            if table.dtype == np.uint8:
                per_mask = np.bincount(masks, minlength=256)
                found += [per_mask[(np.arange(256) >> b) & 1 == 1].sum() for b in range(n)]
            else:
                found += [((masks >> kind(b)) & kind(1)).sum() for b in range(n)]
        return np.array(found, float)

    def decide(self, text: str | None) -> tuple[str, float]:
        words = normal(text)
        if not self.languages or not any(c.isalpha() for c in words):
            return UNDETERMINED, 0.0
        h = gram_hashes(words)
        sure = np.maximum(0.0, (self.counts(h) - len(h) * self.rates) / (1 - self.rates))
        if not sure.any():
            return self.languages[self.usual], 1.0 / len(self.languages)
        best = int(sure.argmax())
        return self.languages[best], float(1.0 / ((sure / sure[best]) ** SHARPNESS).sum())


def fit(docs: DataFrame, held_out: Column) -> Filters:
    """Filters from documents that aren't held out and have a language and a text.

    Of each language, documents enter by a hash of their text, DOCS_PER_LANGUAGE of them in
    the mean or all if there are fewer; whole texts are counted. Only hashes of the n-grams that are common
    in these documents come to the driver. Equal texts enter together; a text with several languages counts for
    each. Columns besides lang, text and those of ``held_out`` are ignored.
    """
    labelled = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return Filters()
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, DOCS_PER_LANGUAGE / r["count"]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    drawn = stored(labelled.filter(draw < share[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
            for lang, group in texts.groupby("lang"):
                hashes, n = np.unique(np.concatenate([gram_hashes(normal(t)) for t in group["text"]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(hashes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.filter(F.col("n") >= LEAST_COUNT)
    totals = drawn.groupBy("lang").agg(F.sum(F.char_length("text")).alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.greatest("total", F.lit(1)))
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("lang", "rate", "n")).alias("in"))
    kept = stored(highest.select("gram", "highest", F.explode("in").alias("e")).filter(F.col("e.rate") >= LEAST_SHARE * F.col("highest")))
    names = sorted(r["lang"] for r in sizes)
    grams = []
    for name in names:
        rows = kept.filter(F.col("e.lang") == name).select("gram").toPandas()
        grams.append(np.sort(rows["gram"].to_numpy(dtype=np.int64)).view(np.uint64))
    return Filters.of(names, grams, names.index(sizes[0]["lang"]))


def language(filters: Filters, text: Column) -> Column:
    """struct<lang_pred, score> of a text column; ``und`` and 0 for null and for texts without a letter. Texts of any length are read whole; equal texts have equal results."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(t) for t in texts], columns=["lang_pred", "score"])

    return decide(text)
