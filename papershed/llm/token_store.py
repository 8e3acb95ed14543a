"""A content-addressed store of token ids.

Layout below one folder, all Parquet:

* ``objects/kind=chunk``: ``key`` (SHA-256 of the bytes), ``body`` (ids, little-endian, 16 bit if the
  vocabulary allows, else 32), one row for each distinct chunk.
* ``recipes``: ``part, doc_id, n_tokens, chunks`` (the keys in order), ``leaf`` (SHA-256 of doc_id, n_tokens
  and the keys), in ascending doc_id order through the parts.
* ``manifest``: ``part, n_docs, n_tokens, root``, the root being the Merkle root over the leaves.
* ``head``: one row with the number of parts and the hash of their manifest rows in order.

Readers make every leaf and root anew from the recipes, hold them against manifest and head, and hold
each chunk they read against its key. A changed, lost or added part, recipe or chunk ends the read.

A rolling hash over the last 16 ids says where a chunk ends, so an edit changes the chunks
around it and no others, and passages that documents share are stored once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papershed.llm.common import remove
from papershed.llm.tokens import encoder, slices, specification

#: A chunk ends where the hash has its high bits clear, every 512 ids in the mean, but is no shorter or longer than this.
MASK, LEAST, MOST = np.uint32(511), 64, 4096
#: Keys of chunks that a task remembers having sent on, some 10 MB.
SEEN_KEYS = 100_000
#: Words whose ids a worker remembers while a store is written: little else is in its memory then.
WORDS_KEPT = 900_000
#: Ids that the hash looks back on; no more than the shortest chunk, so that it never sees another document's ids.
WINDOW = 16


def _gear(size: int) -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each id (the low half of splitmix64)."""
    x = (np.arange(1, size + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


def chunk_ends(ids: np.ndarray, documents: np.ndarray, gear: np.ndarray) -> list[list[int]]:
    """For documents that lie one after the other in ``ids``, by their ends, the ends of each one's chunks."""
    h = gear[ids]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    cuts = (np.flatnonzero((h >> np.uint32(20)) & MASK == 0) + 1).tolist()
    found, start, at = [], 0, 0
    for last in documents.tolist():
        ends = []
        while True:
            end = cuts[at] if at < len(cuts) and cuts[at] < last else last
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end == last:
                ends.append(last)
                start = last
                break
            if end - start >= LEAST:
                ends.append(end)
                start = end
            at += 1
        while at < len(cuts) and cuts[at] <= last:
            at += 1
        found.append(ends)
    return found


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the whole store. A null text counts as empty; a document has its end id at least.

    Texts are encoded once. Chunks and recipes leave that pass together. A task sends a chunk on once
    for each SEEN_KEYS different ones, so copies are dropped before the shuffle without sorting bodies;
    there chunks meet the copies from other tasks. Recipes go on to be sorted. Repeated rows have
    recipes of their own; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(specification(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, "leading", WORDS_KEPT)
        size = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        kind, gear, serial = np.dtype(_kind(size)), _gear(size), 0
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            encoded = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            ids = np.frombuffer(b"".join([b + end for b in encoded]), dtype="<u4")
            n_tokens = np.array([len(b) // 4 + 1 for b in encoded])
            ends = chunk_ends(ids, np.cumsum(n_tokens), gear)
            packed, width, at = ids.astype(kind).tobytes(), kind.itemsize, 0
            chunks: list[bytes] = []
            own_chunks: list[list[bytes]] = []
            bodies: dict[bytes, bytes] = {}
            for own in ends:
                first = len(chunks)
                for stop in own:
                    body = packed[at * width : stop * width]
                    key = hashlib.sha256(body).digest()
                    chunks.append(key)
                    if key not in seen:
                        bodies[key] = body
                    at = stop
                own_chunks.append(chunks[first:])
            if len(seen) > SEEN_KEYS:
                seen.clear()
            seen.update(bodies)
            n, task, ids_of = batch.num_rows, batch.column("task").to_pylist(), batch.column("doc_id").to_pylist()
            leaves = list(map(leaf_of, ids_of, n_tokens.tolist(), own_chunks))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in ends])]), pa.int32())
            recipes = pa.StructArray.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(chunks, pa.binary())), pa.array(leaves, pa.binary())],
                fields=list(RECIPE),
            )
            yield rows("chunk", list(bodies), list(bodies.values()), pa.nulls(len(bodies), RECIPE))
            yield rows("recipe", [f"{task[k]}-{serial + k}".encode() for k in range(n)], [b""] * n, recipes)
            serial += n

    def rows(kind: str, keys: list[bytes], bodies: list[bytes], recipes: pa.Array) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(keys)), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary()), recipes]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "body", "recipe"])

    objects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("task")).mapInArrow(
        encode, "kind string, key binary, body binary, recipe struct<doc_id: long, n_tokens: long, chunks: array<binary>, leaf: binary>"
    )
    objects.repartition("kind", "key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{path}/objects")
    loose = spark.read.schema(OBJECTS).parquet(f"{path}/objects").filter("kind = 'recipe'").select("recipe.*")
    ordered = loose.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "leaf")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "chunks", "leaf").write.parquet(f"{path}/recipes")
    _manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")
    head = _head(_stored_manifest(spark, path), _chunks(spark, path))
    spark.createDataFrame([head], HEAD).write.parquet(f"{path}/head")
    remove(spark, f"{path}/objects/kind=recipe")


RECIPE = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("leaf", pa.binary())])
OBJECTS = "key binary, body binary, recipe struct<doc_id: long, n_tokens: long, chunks: array<binary>, leaf: binary>, kind string"
MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def leaf_of(doc_id: int | None, n_tokens: int, chunks: list[bytes]) -> bytes:
    """What a Merkle leaf stands for: the document's id, its number of ids and its chunks in order."""
    return hashlib.sha256(b"".join([f"{doc_id} {n_tokens} ".encode(), *chunks])).digest()


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, n_tokens long, chunks array<binary>, leaf binary").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{path}/objects").filter("kind = 'chunk'").select("key", "body")


def merkle_root(leaves: Iterator[bytes]) -> bytes:
    """The Merkle root of leaves in order, holding one hash for each level at most."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level = 0
        while stack and stack[-1][0] == level:
            leaf = hashlib.sha256(stack.pop()[1] + leaf).digest()
            level += 1
        stack.append((level, leaf))
    root = b""
    for _, node in reversed(stack):
        root = hashlib.sha256(node + root).digest()
    return root


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row for each part of the recipes: its counts and the Merkle root over leaves made anew."""
    sorted_parts = recipes.repartition("part").sortWithinPartitions("part", "doc_id", "leaf")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for part, doc_id, n, chunks, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "chunks", "leaf"))):
                    total = totals.setdefault(part, [0, 0])
                    total[0] += 1
                    total[1] += n
                    made = leaf_of(doc_id, n, chunks)
                    if made != leaf:
                        raise ValueError(f"the recipe of document {doc_id} differs from its leaf")
                    yield part, made

        for part, leaves in groupby(rows(), key=lambda r: r[0]):
            root = merkle_root(leaf for _, leaf in leaves)
            n_docs, n_tokens = totals.pop(part)
            columns = [pa.array([v], k) for v, k in ((part, pa.int32()), (n_docs, pa.int64()), (n_tokens, pa.int64()), (root, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n_docs", "n_tokens", "root"])

    return sorted_parts.mapInArrow(roots, MANIFEST)


def _stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


HEAD = "n_parts long, root string, n_chunks long, chunk_keys long"


def _head(manifest: DataFrame, chunks: DataFrame) -> tuple:
    """Number of parts and digest of the manifest (a row for each part), number of chunks and a digest of their keys in any order."""
    row = F.array_sort(F.collect_list(F.struct("part", F.concat_ws(" ", "part", "n_docs", "n_tokens", F.hex("root")).alias("line"))))
    parts = manifest.agg(F.count("*"), F.sha2(F.array_join(F.transform(row, lambda r: r["line"]), "\n"), 256))
    keys = chunks.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(key))"), F.lit(0).cast("long")))
    return (*parts.first(), *keys.first())


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``, the ids of all documents before.

    Raises ValueError at once if the manifest or the chunks aren't those that the head names, or if a part is
    missing, added, or has other counts or another root than the manifest says.
    """
    recipes, manifest = _recipes(spark, path), _stored_manifest(spark, path)
    if _head(manifest, _chunks(spark, path)) != tuple(spark.read.schema(HEAD).parquet(f"{path}/head").first()):
        raise ValueError("the manifest or the chunks differ from their head")
    now = _manifest(recipes).select("part", *(F.col(c).alias(f"now_{c}") for c in ("n_docs", "n_tokens", "root")))
    same = F.lit(True)
    for c in ("n_docs", "n_tokens", "root"):
        same &= F.col(c).eqNullSafe(F.col(f"now_{c}"))
    wrong = manifest.join(now, "part", "full_outer").filter(~same).select("part").take(1)
    if wrong:
        raise ValueError(f"Merkle root or counts of part {wrong[0]['part']} differ from the manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("part").orderBy("doc_id", "leaf")
    return (
        recipes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .withColumn("place", F.row_number().over(place))
        .join(F.broadcast(parts), "part")
        .select("part", "place", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "chunks", "leaf")
    )


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65536 else "<u4"


def read_documents(spark: SparkSession, path: str, vocabulary: int, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` put together from chunks; all documents or those named.

    Fails if a chunk is missing or differs from its key, or if a document hasn't its number of ids.
    """
    recipes = verified_recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.filter(F.col("doc_id").isin(doc_ids))
    kind = _kind(vocabulary)

    @F.pandas_udf("array<int>")
    def joined(bodies: pd.Series) -> pd.Series:
        return bodies.apply(lambda b: np.frombuffer(b"".join(b), dtype=kind).astype(np.int32))

    refs = recipes.select("part", "place", "doc_id", "start", "n_tokens", F.posexplode("chunks").alias("at", "key"))
    sound = F.unhex(F.sha2("body", 256)) == F.col("key")
    body = F.when(F.coalesce(sound, F.lit(False)), F.col("body")).otherwise(F.raise_error("a chunk is missing or differs from its key").cast("binary"))
    return (
        refs.join(_chunks(spark, path), "key", "left")
        .withColumn("body", body)
        .groupBy("part", "place", "doc_id", "start", "n_tokens")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda c: c["body"]).alias("bodies"))
        .select("doc_id", "start", "n_tokens", joined("bodies").alias("ids"))
        .withColumn("ids", F.when(F.size("ids") == F.col("n_tokens"), F.col("ids")).otherwise(F.raise_error("a document's chunks don't have its length").cast("array<int>")))
    )


def _zeros_operators(powers: int) -> list[np.ndarray]:
    """For each k, what appending 2**k zero bytes does to a CRC-32 register: a table for each of its four bytes."""
    def apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), op[bit], np.uint32(0))
        return out

    one = np.array([zlib.crc32(b"\0", 1 << bit ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for bit in range(32)], dtype=np.uint32)
    found = [one]
    for _ in range(powers - 1):
        found.append(apply(found[-1], found[-1]))
    values, tables = np.arange(256), []
    for op in found:
        table = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            table[bit // 8][values >> bit % 8 & 1 == 1] ^= op[bit]
        tables.append(table)
    return tables


def combine_crcs(crc: np.ndarray, more: np.ndarray, n_bytes: np.ndarray, operators: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of joined byte strings, from those of the parts and the length of the second part."""
    out = crc.astype(np.uint32)
    for k, op in enumerate(operators):
        on = (n_bytes >> k) & 1 == 1
        if on.any():
            x = out[on]
            out[on] = op[0][x & 255] ^ op[1][x >> 8 & 255] ^ op[2][x >> 16 & 255] ^ op[3][x >> 24]
    return out ^ more.astype(np.uint32)


def read_digests(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, read back from the files.

    Every chunk is read once, checked against its key and digested where it lies. A
    document's CRC-32 follows from those of its chunks in the order of its recipe, so the ids
    themselves never travel. Fails if a chunk is missing or differs from its key, or if a document hasn't its number of ids.
    """
    kind = _kind(vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, crc = batch.column("key").to_pylist(), batch.column("body").to_pylist(), []
            size = np.dtype(kind).itemsize
            ends = np.cumsum([0, *map(len, bodies)]) // size * 4
            wide, n = memoryview(np.frombuffer(b"".join(bodies), dtype=kind).astype("<u4").tobytes()), [len(b) // size for b in bodies]
            for key, body, start, end in zip(keys, bodies, ends.tolist(), ends[1:].tolist()):
                if hashlib.sha256(body).digest() != key:
                    raise ValueError(f"chunk {key.hex()} differs from its key")
                crc.append(zlib.crc32(wide[start:end]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["key", "n", "crc"])

    chunks = _chunks(spark, path).mapInArrow(digest, "key binary, n int, crc long")
    recipes = verified_recipes(spark, path)
    refs = recipes.select("part", "place", "doc_id", "start", "n_tokens", F.posexplode("chunks").alias("at", "key"))

    def ordered(field: str) -> Column:
        return F.transform("chunks", lambda c: c[field]).alias(field)

    gathered = (
        refs.join(chunks, "key", "left")
        .withColumn("n", F.coalesce("n", F.raise_error("a chunk is missing").cast("int")))
        .groupBy("part", "place", "doc_id", "start", "n_tokens")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("chunks"))
        .select("doc_id", "start", "n_tokens", ordered("n"), ordered("crc"))
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        operators = _zeros_operators((4 * MOST).bit_length())
        for batch in batches:
            ends = np.cumsum([0, *map(len, batch.column("n").to_pylist())])
            n, crc = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("n", "crc"))
            total = np.add.reduceat(n, ends[:-1]) if len(n) else n
            if not np.array_equal(total, batch.column("n_tokens").to_numpy()):
                raise ValueError("a document's chunks don't have its length")
            size, out = np.diff(ends), np.zeros(batch.num_rows, dtype=np.uint32)
            for step in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > step)
                at = ends[:-1][on] + step
                out[on] = combine_crcs(out[on], crc[at], 4 * n[at], operators)
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return gathered.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")
