import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papershed.llm import radix
from papershed.llm import resample as R
from papershed.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]


def plain(rows, target):
    """(doc_id, features, weight, score) of every row, and the drawn ones in order."""
    s, t = Counter(f for r in rows for f in features(r[1])), Counter(f for x in target for f in features(x))
    n, m = sum(s.values()), sum(t.values())
    out, able = [], []
    for r in rows:
        f = features(r[1])
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n + 10000.0) / ((s[b] + 1.0) * (m + 10000.0)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(words(r[1])) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return out, [(r[0], r[3]) for r in able[: 25 * len(able) // 100]]


def same(spark, documents, rows, target):
    bench = spark.createDataFrame([(str(k), x) for k, x in enumerate(target)], "item_id string, text string")
    got = R.resample(documents(rows), bench).collect()
    out, drawn = plain(rows, target)
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(out, key=str)
    ranks = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert ranks == [(k + 1, *d) for k, d in enumerate(drawn)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9éñ漢 .\n\x7f🙂-", max_size=40), max_size=6))
def test_buckets_of_any_text(texts):
    found, owner, n = R.buckets([t.encode() for t in texts], 10000)
    for k, t in enumerate(texts):
        assert sorted(found[owner == k]) == sorted(features(t)) and n[k] == len(words(t))


def test_buckets_of_long_words():
    texts = ["x" * 5000 + " y", "é" * 24, "a" * 47 + " " + "b" * 48 + " " + "c" * 49 + " d", "", "q" * 48]
    found, owner, _ = R.buckets([t.encode() for t in texts], 10000)
    assert [sorted(found[owner == k]) for k in range(len(texts))] == [sorted(features(t)) for t in texts]


def test_slices_cover_all_texts():
    import pyarrow as pa

    texts = ["a" * 3_000_000, None, "b" * 3_000_000, "", "c" * 9_000_000, "d"]
    parts = list(R._slices(pa.array(texts)))
    assert [x for _, p in parts for x in p] == [(t or "").encode() for t in texts]
    assert [f for f, _ in parts] == list(np.cumsum([0, *(len(p) for _, p in parts)]))[:-1]


def test_odd_rows(spark, documents):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [*ODD, *[(k, f"{long} {k % 7} word{k}") for k in range(-20, 60)], (None, long), (1 << 62, long), (-(1 << 63), long), (5, long), (5, long)]
    same(spark, documents, rows, ["one two three", "word5 漢字", ""])
    same(spark, documents, [], ["one"])
    same(spark, documents, [(k, long) for k in range(9)], [])
    same(spark, documents, [(1, "too short")], ["one"])


def test_ranks_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK", 64)
    draw = random.Random(1)
    rows = [(draw.randint(0, 9), draw.choice([draw.randint(0, 5000), draw.randint(-(1 << 63), (1 << 63) - 1)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, k long").repartition(5)
    got = {r["k"]: r["place"] for r in radix.ranked(df, ["a", "b"]).collect()}
    unsigned = lambda v: v % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0], unsigned(r[1])))
    assert sorted(got.values()) == list(range(3000))
    by_place = sorted(rows, key=lambda r: got[r[2]])
    assert [(r[0], r[1]) for r in by_place] == [(r[0], r[1]) for r in order]


def test_equal_keys_need_one_pass(spark):
    df = spark.createDataFrame([(5, k) for k in range(100)], "a long, k long")
    assert sorted(r["place"] for r in radix.ranked(df, ["a"]).collect()) == list(range(100))


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out, drawn = plain(docs, target)
    rank = {d: k + 1 for k, d in enumerate(drawn)}
    got = QUERIES["op12_importance_resampling"](spark, sf_dir).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((*r, rank.get((r[0], r[3]))) for r in out), key=str)
    assert "op12_importance_resampling" in ORACLE_SQL
