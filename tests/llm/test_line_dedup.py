import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from papershed.llm import line_dedup as L
from papershed.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least_docs=10, least_chars=1):
    """(doc_id, lines, dropped lines, kept text) of every row."""
    key = lambda line: line.strip(L.WHITE).translate(UPPER)
    texts = [(r[0], (r[1] or "").split("\n")) for r in rows]
    docs = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    common = {k for k, n in docs.items() if n >= least_docs and len(k) >= least_chars}
    return [(i, len(lines), sum(key(x) in common for x in lines), "\n".join(x for x in lines if key(x) not in common)) for i, lines in texts]


def same(spark, documents, rows, parts=None, **options):
    docs = documents(rows)
    docs = docs.repartition(parts) if parts else docs
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in L.without_common_lines(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, **options), key=str)


def test_shared_lines_go_everywhere(spark, documents):
    same(spark, documents, [(k, f"Own {k}\n  Shared LINE \t\nown again {k}\nshared line") for k in range(12)])
    same(spark, documents, [(k, f"Own {k}\nshared line") for k in range(9)])
    same(spark, documents, [(k, "all\ngone") for k in range(10)])
    same(spark, documents, [(k, "\r\n".join(["a", "", "É", "b"])) for k in range(10)] + [(77, "é\nÉ\n")])


def test_odd_rows(spark, documents):
    same(spark, documents, ODD)
    same(spark, documents, [])
    same(spark, documents, [(1, "twice\ntwice\nonce")] * 10 + [(None, "twice"), (None, None), (3, "\n" * 5000 + "TWICE")])
    same(spark, documents, [(1, "twice\ntwice\nonce")] * 9)
    same(spark, documents, ODD * 2, least_docs=2, least_chars=5)


def test_hot_lines_over_many_ranges(spark, documents):
    draw = random.Random(3)
    rows = [(k, "\n".join(draw.choice(["hot", "warm %d" % (k % 40), "cold %d" % k, "hot ", ""]) for _ in range(12))) for k in range(600)]
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        same(spark, documents, rows, parts=7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_stream_over_any_ranges_and_batches():
    """Ranges cut between documents of a key, batches anywhere: the lines to drop stay the same."""
    draw = random.Random(5)
    for _ in range(200):
        keys = sorted({(draw.randint(0, 3), 0, draw.randint(0, 40), 0, draw.randint(0, 2)) for _ in range(draw.randint(1, 90))})
        rows = [(*k, draw.choice([1, 1, 1, 3])) for k in keys]
        docs = Counter()
        for h in {r[0] for r in rows}:
            docs[h] = sum(min((r[4], r[5]) for r in rows if r[0] == h and r[2] == d)[1] for d in {r[2] for r in rows if r[0] == h})
        expect = {(r[2], r[3], r[4]) for r in rows if docs[r[0]] >= 10}
        expect_all = sorted((r[0], r[2], r[4]) for r in rows if docs[r[0]] >= 10)
        cuts = [0, *sorted(k for k in range(1, len(rows)) if rows[k][:4] != rows[k - 1][:4] and draw.random() < 0.2), len(rows)]
        lines, told, unsure = [], Counter(), []
        for a, b in zip(cuts, cuts[1:]):
            size = draw.randint(1, 20)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : min(k + size, b)])], list(L.COLUMNS)) for k in range(a, b, size)]
            for out in L._stream(10)(iter(batches)):
                for h1, _, d1, d2, pos, n in zip(*(out.column(c).to_pylist() for c in L.COLUMNS)):
                    if h1 is None:
                        lines.append((d1, d2, pos))
                    elif n is not None:
                        told[h1] += n
                    else:
                        unsure.append((h1, (d1, d2, pos)))
        lines += [place for h, place in unsure if told[h] >= 10]
        assert set(lines) == expect and len(lines) == len(expect_all)


def test_bitmaps_tell_the_lines(spark, documents):
    rows = [(k, "\n".join(["x"] * 9 + ["shared", "last"])) for k in range(10)]
    for r in L.keep_bitmaps(documents(rows)).collect():
        import zlib

        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8))
        assert r["n_dropped"] == 11 and list(bits[:11]) == [0] * 11 and all(bits[11:])


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_line_dedup"](spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got) == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(docs))
    assert "op13_line_dedup" in ORACLE_SQL
