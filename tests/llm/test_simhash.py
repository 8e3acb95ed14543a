import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papershed.llm import components, simhash
from papershed.llm.queries import op1_simhash

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \n", "one", "One TWO", "a b c", "É é À b c d", "x " * 5000, "漢字 b c d\x0be f"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    expect = {(i, f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, plain_components(fps))}
    assert {tuple(r) for r in op1_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()} == expect


@pytest.mark.parametrize("bands, radius", [(1, 3), (2, 3), (2, 5)])
def test_trees_lose_no_link(spark, bands, radius):
    rng = np.random.default_rng(bands)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:  # chains and dense balls around the seeds
        x = int(s)
        for _ in range(int(rng.integers(1, 25))):
            for b in rng.integers(0, 64, int(rng.integers(1, radius + 2))):
                x ^= 1 << int(b)
            fps.add(x)
    values = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = components.connected_components(simhash.links(df, radius, bands, leaf=40)).collect()
    root = {r["node"]: r["root"] for r in found}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(values))])
        if (new == label).all():
            break
        label = new
    groups = {}
    for v, c in zip(values.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(c, set()).add(v)
    mine = {}
    for v in values.view(np.int64).tolist():
        mine.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_over_full_leaves_are_split(spark, monkeypatch):
    """With a small sample the first trees can't bear enough leaves; more levels make them, and no link is lost."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 400), dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ f for f in flips), rng.integers(0, 2**64, 2000, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = lambda links: {frozenset((r["node"], r["root"])) for r in components.connected_components(links).collect()}
    want = roots(simhash.links(df, 3, 2, leaf=10**9))
    monkeypatch.setattr(simhash, "SAMPLE", 64)
    found = simhash.shards(df, 3, 2, leaf=100).filter("home").groupBy("leaf").count().collect()
    assert sum(r["count"] for r in found) == 2 * len(values)  # a home in each band
    assert max(r["count"] for r in found) < 400 and len(found) > 40
    assert roots(simhash.links(df, 3, 2, leaf=100)) == want


def test_odd_rows(spark, documents):
    found = simhash.near_duplicates(documents(ODD)).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert by_id[4] == 3 and by_id[5] == 3 and by_id[9] == 8 and by_id[10] == 10
    assert simhash.near_duplicates(documents([])).collect() == []


def test_one_of_each_keeps_columns_and_one_copy(spark, documents):
    docs = documents(ODD)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in {3, 6, 7, 8, 10, 11, 12, None})


def test_star_and_chain_components(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 320)] + [(900, 800)]
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert found == {**{k: 0 for k in range(200)}, **{k: 300 for k in range(300, 321)}, 800: 800, 900: 800}
    assert components.connected_components(df.filter(F.lit(False))).collect() == []


def test_one_of_each_knows_rows_without_an_id_of_their_own(spark, documents):
    a, b, c, d = (" ".join(f"{k}{n}" for n in range(60)) for k in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (2, c), (None, a)]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(documents(rows)).collect())
    assert kept == sorted([("None", a), ("None", b), ("1", c), ("1", d)])
