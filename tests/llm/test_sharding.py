import zlib

from pyspark.sql import functions as F

from papershed.llm import sharding as S
from papershed.llm.queries import QUERIES, op7_sharding

from .conftest import ODD


def run(spark, documents, tmp_path, rows):
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    return op7_sharding(spark, str(tmp_path)).collect()


def test_odd_rows_all_find_a_place(spark, documents, tmp_path):
    found = run(spark, documents, tmp_path, ODD)
    expect = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == expect
    for shard in {r["shard"] for r in found}:
        places = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert {r["law"] for r in found} == {"bytes"} and all(0 <= r["shard"] < 40 and r["grown_shard"] is None for r in found)


def test_no_rows(spark, documents, tmp_path):
    assert run(spark, documents, tmp_path, []) == []


def test_bytes_are_near_equal(spark, sf_dir):
    found = QUERIES["op7_sharding"](spark, sf_dir.replace("0.001", "0.01"))
    loads = [r["b"] for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = found.agg(F.max("size")).first()[0]
    assert len(loads) == 40 and max(loads) - min(loads) <= largest


def test_growing_moves_slots_into_the_new_shard_alone(spark, tmp_path):
    records = spark.range(5000).select(S.virtual_slot(F.col("id")).alias("virtual_slot"), (F.col("id") % 97 + 1).alias("size"))
    slots = S.slot_bytes(records).cache()
    first = S.write_map(S.make_map(slots, 8), f"{tmp_path}/maps")
    second = S.write_map(S.grow_map(first, slots, 8), f"{tmp_path}/maps")
    old = {r["virtual_slot"]: r["shard"] for r in S.read_map(spark, f"{tmp_path}/maps", 1).collect()}
    new = {r["virtual_slot"]: r["shard"] for r in second.collect()}
    assert old.keys() == new.keys() and {r["version"] for r in second.collect()} == {2}
    assert all(new[s] in (old[s], 8) for s in old)
    size = {r["virtual_slot"]: r["bytes"] for r in slots.collect()}
    loads = [sum(size[s] for s in new if new[s] == k) for k in range(9)]
    assert max(loads) - min(loads) < 0.1 * max(loads)


def test_against_brute_force(spark, sf_dir):
    """Slots dealt largest first to the least loaded shard, and places counted, in plain Python."""
    found = op7_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in found) and len(found) == len(texts)
    sums, loads, shard = {}, [0] * 40, {}
    for r in found:
        sums[r["virtual_slot"]] = sums.get(r["virtual_slot"], 0) + r["size"]
    for slot in sorted(sums, key=lambda s: (-sums[s], s)):
        shard[slot] = loads.index(min(loads))
        loads[shard[slot]] += sums[slot]
    taken = [0] * 40
    for r in sorted(found, key=lambda r: (r["virtual_slot"], r["doc_id"], r["size"], r["text_crc32"])):
        assert (r["shard"], r["slot"]) == (shard[r["virtual_slot"]], taken[r["shard"]])
        taken[r["shard"]] += 1
