"""Resampling of documents towards a target distribution by importance weights.

Features are single words and pairs of consecutive words, hashed into buckets. A bucket's gain
is the logarithm of its share in the target over its share in the corpus, a document's weight the
mean gain of its features, and its score the weight with Gumbel noise from a hash of its doc_id, so
that the highest scores are a draw without replacement by weight. Counting and scoring run over
arrays of buckets, a slice of texts at a time; ranks come from the radix sort in ``radix``.

Words are runs of digits, a-z and anything beyond ASCII after lower-casing A-Z, which can be told
from the bytes of UTF-8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import LOWER, UPPER, stored
from papershed.llm.radix import ranked

BUCKETS, LEAST_WORDS, SHARE, SALT = 10_000, 20, 25, "7"
#: Bytes of text from which a slice ends, and bytes from which a word's checksum is taken alone.
SLICE, LONG = 4 << 20, 48

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
IS_WORD = bytes(c >= 0x80 or chr(c).isdigit() or chr(c).islower() for c in range(256))


def _crc_table() -> np.ndarray:
    """The register after each byte value, by the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def _advance(register: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: bytes) -> np.ndarray:
    """CRC-32 registers after each has read its word."""
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    at, left, now = starts[order], lengths[order], register[order]
    long = int(np.searchsorted(-left, -LONG, "left")) if len(left) else 0
    for k in range(long):
        word = raw[at[k] : at[k] + left[k]]
        now[k] = zlib.crc32(word, int(now[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    at, left, rest = at[long:], left[long:], now[long:]
    for k in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -k, "left")
        head = rest[:n]
        rest[:n] = CRC[(head ^ data[at[:n] + k]) & 0xFF] ^ (head >> 8)
    out = np.empty_like(now)
    out[order] = now
    return out


def buckets(texts: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the number of words of every text."""
    raw = b"\n".join(texts).translate(TO_LOWER)
    data = np.frombuffer(raw, np.uint8)
    edges = np.diff(np.frombuffer(b"\0" + raw.translate(IS_WORD) + b"\0", np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(begins, starts, "right") - 1
    first = _advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends - starts, raw)
    paired = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, int)
    space = CRC[(first[paired] ^ 0x20) & 0xFF] ^ (first[paired] >> 8)
    both = _advance(space, data, starts[paired + 1], (ends - starts)[paired + 1], raw)
    features = (np.concatenate([first, both]) ^ np.uint32(0xFFFFFFFF)) % np.uint32(n_buckets)
    return features.astype(np.int64), np.concatenate([owner, owner[paired]]), np.bincount(owner, minlength=len(texts))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in slices of some SLICE bytes, with the number of the first; a longer text is a slice of its own."""
    texts, size, first = [], 0, 0
    for k, text in enumerate(column.cast(pa.binary())):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= SLICE:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of ``text`` fall in each bucket; one number a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column("text")):
                total += np.bincount(buckets(part, n_buckets)[0], minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    total = np.zeros(n_buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of shares, one added to each count, rounded down."""
    n = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scores(docs: DataFrame, gain: np.ndarray, salt: str = SALT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, part in _slices(batch.column("text")):
                feature, owner, words = buckets(part, len(gain))
                rows = slice(first, first + len(part))
                n_words[rows] = words
                count[rows] = np.bincount(owner, minlength=len(part))
                total[rows] = np.bincount(owner, weights=gain[feature], minlength=len(part))
            weight = np.where(count > 0, total.astype(np.int64) // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, count, weight))], names)

    names = ["doc_id", "n_words", "n_features", "weight"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, ", ".join(f"{c} long" for c in names))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; ``share`` per cent of those with ``least_words`` words are drawn.

    ``rank`` counts from 1 in descending order of score, equal scores by ascending doc_id, and is
    null for documents that aren't drawn. Null and empty texts have no features and weight 0, a
    null doc_id counts as empty in the noise and comes before others at equal scores; rows that agree in score and doc_id have ranks of their own in any order. Texts are
    read whole however long, other columns are ignored, and no documents give no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = stored(scores(docs, gain))
    able = scored.filter(F.col("n_words") >= least_words)
    n, most = able.agg(F.count("*"), F.max("score")).first()
    keyed = able.select(
        "doc_id", "n_features", "weight", "score",
        (F.lit(most) - F.col("score")).cast("long").alias("fall"),
        F.col("doc_id").isNotNull().cast("long").alias("named"),
        F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))).alias("number"),  # signed order as unsigned order
    )
    place = ranked(keyed, ["fall", "named", "number"])
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = F.when(F.col("place") < n * share // 100, F.col("place") + 1).cast("long")
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return place.select(*columns, drawn.alias("rank")).union(rest)
