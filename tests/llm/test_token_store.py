import os
import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papershed.llm import token_store as S

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return {str(i): np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in rows}


def test_round_trip_of_odd_rows(spark, documents, tmp_path):
    S.write_store(documents(ODD), str(tmp_path / "s"), PATH, 2)
    ids = expected(ODD)
    found = S.read_digests(spark, str(tmp_path / "s"), 50257).collect()
    assert len(found) == len(ODD)
    order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in found), key=lambda i: -1 if i is None else i)
    at = 0
    for r in order:
        whole = ids[str(r["doc_id"])]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(whole), zlib.crc32(whole.tobytes()))
        at += len(whole)
    for r in S.read_documents(spark, str(tmp_path / "s"), 50257).collect():
        assert r["ids"] == ids[str(r["doc_id"])].tolist()


def test_chunks_are_stored_once(spark, documents, tmp_path):
    text = " ".join(f"word{k}" for k in range(3000))
    S.write_store(documents([(k, text) for k in range(20)]), str(tmp_path / "s"), PATH, 2)
    stored = S._chunks(spark, str(tmp_path / "s")).collect()
    assert len({r["key"] for r in stored}) == len(stored)
    assert sum(len(r["body"]) for r in stored) == 2 * len(expected([(0, text)])["0"])


def test_no_rows(spark, documents, tmp_path):
    S.write_store(documents([]), str(tmp_path / "s"), PATH, 2)
    assert S.read_digests(spark, str(tmp_path / "s"), 50257).collect() == []


def rewritten(spark, path, name, change):
    """Replaces a part of a store by what ``change`` makes of it."""
    change(spark.read.parquet(f"{path}/{name}")).write.parquet(f"{path}/new")
    os.rename(f"{path}/{name}", f"{path}/was-{name.replace('/', '-')}")
    os.rename(f"{path}/new", f"{path}/{name}")


DAMAGE = {
    "changed root": ("manifest", lambda d: d.withColumn("root", F.lit("x").cast("binary"))),
    "changed counts": ("manifest", lambda d: d.withColumn("n_docs", F.col("n_docs") + 1)),
    "lost manifest row": ("manifest", lambda d: d.filter("part > 0")),
    "lost part": ("recipes", lambda d: d.filter("part > 0")),
    "all parts lost": ("recipes", lambda d: d.limit(0)),
    "lost recipe": ("recipes", lambda d: d.filter("doc_id <> 2")),
    "reordered chunks": ("recipes", lambda d: d.withColumn("chunks", F.reverse("chunks"))),
    "reordered chunks with leaves to match": (
        "recipes",
        lambda d: d.withColumn("chunks", F.reverse("chunks")).withColumn("leaf", F.udf(S.leaf_of, "binary")("doc_id", "n_tokens", "chunks")),
    ),
    "changed length": ("recipes", lambda d: d.withColumn("n_tokens", F.col("n_tokens") + 1)),
    "lost chunk": ("objects/kind=chunk", lambda d: d.orderBy("key").offset(1)),
    "all chunks lost": ("objects/kind=chunk", lambda d: d.limit(0)),
    "added chunk": ("objects/kind=chunk", lambda d: d.union(d.limit(1).selectExpr("unhex(sha2('abcd', 256))", "cast('abcd' as binary)", *d.columns[2:]))),
    "repeated chunk": ("objects/kind=chunk", lambda d: d.union(d.limit(1))),
    "exchanged chunk": ("objects/kind=chunk", lambda d: d.orderBy("key").offset(1).union(d.limit(1).selectExpr("unhex(sha2('abcd', 256))", "cast('abcd' as binary)", *d.columns[2:]))),
    "added recipe": ("recipes", lambda d: d.union(d.filter("doc_id = 3").withColumn("doc_id", F.lit(99).cast("long")).withColumn("leaf", F.udf(S.leaf_of, "binary")("doc_id", "n_tokens", "chunks")))),
    "added part": ("recipes", lambda d: d.union(d.filter("part = 0").withColumn("part", F.lit(999)))),
    "changed chunk": ("objects/kind=chunk", lambda d: d.withColumn("body", F.when(F.octet_length("body") > 4, F.expr("substring(body, 3)")).otherwise(F.lit("ab").cast("binary")))),
}


@pytest.fixture(scope="module")
def small_store(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so that there are several parts
    S.write_store(documents([(k, " ".join(f"word{j} {k}" for j in range(900))) for k in range(1, 13)]), path, PATH, 2)
    spark.conf.unset(coalesce)
    assert spark.read.parquet(f"{path}/recipes").selectExpr("max(part)").first()[0] > 0
    return path


@pytest.mark.parametrize("damage", DAMAGE)
@pytest.mark.parametrize("read", [S.read_digests, S.read_documents])
def test_damage_is_found(spark, small_store, tmp_path, read, damage):
    path = str(tmp_path / "s")
    shutil.copytree(small_store, path)
    assert read(spark, path, 50257).count() == 12
    rewritten(spark, path, *DAMAGE[damage])
    with pytest.raises(Exception, match="head|manifest|leaf|missing|differs from its key|length"):
        read(spark, path, 50257).collect()


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_crcs(a, b):
    out = S.combine_crcs(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]), S._zeros_operators(10))
    assert int(out[0]) == zlib.crc32(a + b)


def test_an_edit_changes_few_chunks():
    rng = np.random.default_rng(0)
    ids, gear = rng.integers(0, 50000, 20000).astype(np.uint32), S._gear(50257)
    other = np.insert(ids, 10000, [1, 2, 3])

    def cut(x):
        ends = S.chunk_ends(x, np.array([len(x)]), gear)[0]
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    assert len(cut(other) - cut(ids)) <= 3


def test_chunks_do_not_depend_on_other_documents():
    rng = np.random.default_rng(1)
    gear, parts = S._gear(50257), [rng.integers(0, 50000, n).astype(np.uint32) for n in (1, 5000, 64, 12000, 700)]
    ends = S.chunk_ends(np.concatenate(parts), np.cumsum([len(p) for p in parts]), gear)
    at = 0
    for part, own in zip(parts, ends):
        assert [e - at for e in own] == S.chunk_ends(part, np.array([len(part)]), gear)[0]
        at += len(part)


def test_merkle_root_depends_on_order():
    leaves = [bytes([k]) * 32 for k in range(5)]
    assert S.merkle_root(iter(leaves)) != S.merkle_root(iter(leaves[::-1])) and S.merkle_root(iter([])) == b""
