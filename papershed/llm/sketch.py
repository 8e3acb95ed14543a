"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so two sketches of any
two documents, however unequal, are samples of their shingles by one rule: they can be merged,
and likeness and containment can be estimated from them alone. Texts with few hashes below the
threshold keep their FLOOR smallest instead (all, if there are fewer); the sketch says up to which
hash it is complete, and two sketches are compared up to where both are.

Shingles are runs of 12 code points; a shorter text is one shingle.
As a string, a sketch is that bound and the hashes in ascending order, 8 hex digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FRACTION, FLOOR = 12, 64, 64
LIMIT = (1 << 32) // FRACTION - 1
ALL = (1 << 32) - 1
NULL_KEY = -(1 << 63)
ROWS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    """32-bit hashes of all shingles, in order of the text."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    base, width = np.uint64(0x100000001B3), min(WIDTH, len(h))
    if not width:
        return np.zeros(0, np.uint32)
    powers = {1: h}
    for w in (2, 4, 8):  # hashes of runs twice as long, from those of their halves
        if w <= width:
            half = powers[w // 2]
            powers[w] = half[: len(half) - w // 2] * base ** np.uint64(w // 2) + half[w // 2 :]
    out, done = np.zeros(len(text) - width + 1, np.uint64), 0
    for w in (8, 4, 2, 1):
        if width & w:
            out = out * base ** np.uint64(w) + powers[w][done : done + len(out)]
            done += w
    return (_mix(out) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """(bound, hashes): all distinct hashes up to the bound, ascending."""
    return _kept(shingle_hashes(text or ""))


def _kept(h: np.ndarray) -> tuple[int, np.ndarray]:
    below = np.unique(h[h <= LIMIT])
    if len(below) >= FLOOR:
        return LIMIT, below
    every = np.unique(h)
    if len(every) <= FLOOR:
        return ALL, every
    return int(every[FLOOR - 1]), every[:FLOOR]


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both documents' shingles together, as far as both are complete."""
    bound = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    both = both[both <= bound]
    return max(bound, LIMIT) if len(both) >= FLOOR and bound >= LIMIT else bound, both


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of common shingles in all; 1 for two texts without shingles."""
    bound = min(a[0], b[0])
    x, y = (s[1][: np.searchsorted(s[1], bound, side="right")] for s in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - common
    return common / total if total else 1.0


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of a's shingles that b has; 1 for a text without shingles."""
    bound = min(a[0], b[0])
    x, y = (s[1][: np.searchsorted(s[1], bound, side="right")] for s in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 1.0


def encoded(s: tuple[int, np.ndarray]) -> str:
    return np.concatenate([[s[0]], s[1]]).astype(">u4").tobytes().hex()


def decoded(text: str) -> tuple[int, np.ndarray]:
    values = np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)
    return int(values[0]), values[1:]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``key, text, part, tail`` with the rows of a part next to each other, in order.

    Parts are ranges of doc_id between quantiles. Each part's first documents are in the part before
    as well, with ``tail`` set, so that every row finds the next one in its part; the last part has
    the very first ones. Only a bound and a first doc_id for each part come to the driver.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), "text")
    shares = [k / parts for k in range(1, parts)]
    found = keyed.approxQuantile("key", shares, 1 / (4 * parts)) if parts > 1 else []
    bounds = np.unique(np.array(found, dtype=float).astype(np.int64))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right"), dtype="int32")

    firsts = keyed.select("key", part_of("key").alias("part")).groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()
    before = {r["first"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def part_before(keys: pd.Series) -> pd.Series:
        return keys.map(before).astype("Int32")

    copies = keyed.withColumn("part", part_of("key")).withColumn("earlier", part_before("key"))
    places = F.array_compact(
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("tail")),
            F.when(F.col("earlier").isNotNull(), F.struct(F.col("earlier").alias("part"), F.lit(True).alias("tail"))),
        )
    )
    return (
        copies.select("key", "text", F.explode(places).alias("p"))
        .select("key", "text", "p.part", "p.tail")
        .repartitionById(parts, "part")  # one part a task; hashed part numbers would meet in some tasks
        .sortWithinPartitions("part", "tail", "key", "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: sketches of its text and of its edited text, and their likeness.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A null text counts as empty; an empty text has no shingles, and two such texts
    are fully alike. Rows follow each other by (doc_id, text), null doc_ids first; the
    first follows the last, and a single document follows itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last: tuple | None = None  # part, key, text and sketch of the row that waits for the next
        for batch in batches:
            for key, text, part, tail in zip(*(batch.column(c) for c in ("key", "text", "part", "tail"))):
                key, text, part, tail = key.as_py(), text.as_py(), part.as_py(), tail.as_py()
                if tail and (last is None or last[0] != part):
                    continue  # a further row with the next part's first doc_id
                own = sketch(text)
                if last is not None:
                    if last[0] != part:
                        raise ValueError("a part's last row has no next one")
                    was, new = last[2], edited(last[2], text)
                    changed = sketch(new)
                    rows.append(
                        (None if last[1] == NULL_KEY else last[1], len(was), hashlib.sha256(new.encode()).hexdigest(),
                         encoded(last[3]), encoded(changed), likeness(last[3], changed), likeness(last[3], own))
                    )
                last = None if tail else (part, key, text, own)
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
        if last is not None:
            raise ValueError("a part's last row has no next one")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(slim, parts).mapInArrow(compute, schema)
