import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from papershed.llm import packing as P
from papershed.llm.queries import PACKING_END_ID

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, capacity):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [PACKING_END_ID], dtype="<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((str(i), k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def check(found, rows, capacity):
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected(rows, capacity)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_odd_rows(spark, documents, capacity):
    rows = [*ODD, (13, "<|endoftext|> a  b\n\nc's  "), (14, "x" * 9000)]
    check(P.best_fit_packing(documents(rows), PATH, PACKING_END_ID, capacity).collect(), rows, capacity)


def test_no_rows(spark, documents):
    assert P.best_fit_packing(documents([]), PATH, PACKING_END_ID).collect() == []


def test_few_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = P.best_fit_packing(docs, PATH, PACKING_END_ID).collect()
    n = check(found, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)
    assert n <= -(-sum(r["length"] for r in found) // 4096) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3, 1.2, 4000).astype(int) + 1, 1, 128)
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist()))
    plan = P.best_plan(histogram, 128)
    free, used = {}, {}
    for length, first, times, sequence, offset in plan.tolist():
        n = min([f for l, f, *_ in plan.tolist() if l == length and f > first] + [histogram[length]]) - first
        for k in range(n):
            used[length] = used.get(length, 0) + 1
            free.setdefault(sequence + k // times, []).append((offset + k % times * length, length))
    assert used == histogram
    for places in free.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 128
    assert len(free) <= -(-int(lengths.sum()) // 128) + 2


def test_fit_uses_patterns():
    histogram = {60: 1000, 40: 1000, 28: 1000}
    assert P.packing_plan(histogram, 128)[1] == 1000 < P.packing_plan(histogram, 128, fit=False)[1]


def test_kept_ids(spark, documents):
    row = P.token_pieces(documents([(1, "hello world")]), PATH, 1, keep_ids=True).first()
    assert zlib.crc32(row["ids"]) == row["ids_crc32"] and len(row["ids"]) == 4 * row["length"]
