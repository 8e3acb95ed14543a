"""Rows that belong together and lie together, handed to a function in Arrow tables that hold them whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where rows begin that agree in all columns with those after them; nulls are equal."""
    return np.unique(np.concatenate([np.r_[0, pc.run_end_encode(rows.column(c).combine_chunks()).run_ends.to_numpy()[:-1]] for c in columns])).astype(np.int64)


def edge(key: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before."""
    return np.r_[True, key[1:] != key[:-1]]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows each, for rows that hold long lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def matches(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)


def heaviest(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The value with the greatest sum of weights in each group, the larger of equal ones; groups are 0, 1, 2, ..."""
    order = np.lexsort((value, group))
    at = np.flatnonzero(edge(group[order]) | edge(value[order]))
    sums, of, value = np.add.reduceat(weight[order], at), group[order][at], value[order][at]
    order = np.lexsort((value, sums, of))
    return value[order][np.r_[np.flatnonzero(edge(of[order]))[1:], len(of)] - 1]


def whole(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], made: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``made`` gives for tables in which rows that agree in the columns are whole: those of a batch, and the last ones of the batch before."""
    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            now = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            last = int(starts(now, columns)[-1])
            if last:
                yield made(now.slice(0, last))
            rest = [now.slice(last)]
    if rest:
        yield made(rest[0])
