"""Best-fit packing through length patterns.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths has at
most ``capacity`` rows however many documents there are; from it alone the driver makes a
packing plan: patterns of up to four lengths that fill a sequence, repeat counts fitted to the
histogram by non-negative least squares, rounded down, and the residual packed best-fit by
runs. Every piece then finds its sequence from its length and its rank among pieces of that
length; pieces themselves are never gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papershed.llm.common import stored
from papershed.llm.tokens import encoder, slices, specification

CAPACITY = 4096
#: Pieces of one length are ranked in so many parts, so that a very common length is no single task.
RANK_PARTS = 256
FIT_ROUNDS = 300
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if kept, ``ids`` (32-bit little-endian).

    Every document has its end id, so a null or empty text is one piece of one token. Only
    documents longer than ``capacity`` are cut. Columns besides doc_id and text are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(specification(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, "dropped")
        for batch in (part for whole in batches for part in slices(whole)):
            ids = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), ids):
                body += end
                for at in range(0, len(body), width):
                    part = body[at : at + width]
                    for column, value in zip(rows, (doc_id, at // width, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = [pa.array(r, k) for r, k in zip(rows, kinds)]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays(columns[:n], names[:n])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def _patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0 for none) that fill a sequence to at least 98 percent."""
    present = np.sort(lengths)

    def best(room: np.ndarray) -> np.ndarray:
        """The largest present length that fits, else 0."""
        at = np.searchsorted(present, room, side="right") - 1
        return np.where(at >= 0, present[np.maximum(at, 0)], 0)

    grid = np.unique(np.quantile(present, np.linspace(0, 1, 9)).astype(int))
    found = [np.stack([present, best(capacity - present)] + [np.zeros_like(present)] * 2, 1)]
    for b in grid:
        second = best(np.minimum(capacity - present, b))
        found.append(np.stack([present, second, best(capacity - present - second), np.zeros_like(present)], 1))
        for c in grid[grid <= b][::2]:
            third = best(np.minimum(capacity - present - second, c))
            found.append(np.stack([present, second, third, best(capacity - present - second - third)], 1))
    rows = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    total = rows.sum(1)
    return rows[(total <= capacity) & (total >= 0.98 * capacity)]


def _fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with least squares distance between what the patterns use and the counts.

    Accelerated projected gradient; index 0 stands for no length and is left out.
    """
    target = counts.astype(float).copy()
    target[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(target))
        out[0] = 0.0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r[0] = 0.0
        return r[rows].sum(1)

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(FIT_ROUNDS):
        new = np.maximum(0.0, y + back(target - used(y)) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _residual(left: np.ndarray, capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times)]): largest first, each gap closed by the largest that fits.

    Equal sequences come out as one run, and each run uses up a length, so there are no more
    runs than lengths.
    """
    lengths = np.flatnonzero(left)
    while len(lengths):
        room, pattern = capacity, []
        at = len(lengths) - 1
        while at >= 0 and room > 0:
            length = int(lengths[at])
            times = min(int(left[length]), room // length)
            if times:
                pattern.append((length, times))
                room -= times * length
            at = min(at - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
        repeats = min(int(left[length]) // times for length, times in pattern)
        for length, times in pattern:
            left[length] -= repeats * times
        yield repeats, pattern
        lengths = lengths[left[lengths] > 0]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, fit: bool = True) -> tuple[np.ndarray, int]:
    """The plan and its number of sequences.

    A row of the plan is (length, first rank, times, first sequence, offset): pieces of that
    length from that rank on fill the sequences in order, ``times`` in each, from ``offset``.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, runs = counts.copy(), []
    if fit and len(histogram) > 1:
        rows = _patterns(np.flatnonzero(counts), capacity)
        if len(rows):
            x = _fit(rows, counts)
            for i in np.argsort(-x, kind="stable"):
                lengths, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
                repeats = min(int(x[i]), int((left[lengths] // times).min()))
                if repeats > 0:
                    left[lengths] -= repeats * times
                    runs.append((repeats, [(int(a), int(b)) for a, b in zip(lengths, times)]))
    runs.extend(_residual(left, capacity))
    plan, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for repeats, pattern in runs:
        offset = 0
        for length, times in pattern:
            plan.append((length, used[length], times, sequence, offset))
            used[length] += repeats * times
            offset += length * times
        sequence += repeats
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5), sequence


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The fitted plan, unless packing everything as residual takes fewer sequences."""
    plans = [packing_plan(histogram, capacity, fit) for fit in (True, False)]
    return min(plans, key=lambda p: p[1])[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces from ``token_pieces``.

    Only the histogram of lengths, ``capacity`` rows at most, comes to the driver, and only the
    plan goes out: a row for each length of each pattern. Repeated rows are pieces of their own.
    """
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(RANK_PARTS)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(best_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*keys)) - 1)
        .join(bases, ["length", "part"])
        .withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
        .drop("base", "part")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_, rank_, times_, sequence_, offset_ = plan.value.T
        order = (length_ << 48) | rank_
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(order, (length << 48) | rank, side="right") - 1
            within = rank - rank_[at]
            sequence = sequence_[at] + within // times_[at]
            offset = offset_[at] + within % times_[at] * length
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = [f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank"]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; see ``token_pieces`` and ``pack``."""
    return pack(stored(token_pieces(docs, tokenizer, end_id, capacity)), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
