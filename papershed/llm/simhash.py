"""SimHash near-duplicates through a forest of vantage-point trees.

A fingerprint's 64 bits are read in ``BANDS`` bands. Fingerprints that differ in at most RADIUS bits
differ in at most RADIUS // BANDS bits of some band, so each band has a tree of its own, in which a
small radius is enough. A tree's nodes are a vantage point and a median distance, fitted on a
bounded sample of fingerprints; its leaves are the shards of the search. A fingerprint has
its home in one leaf, and by the triangle bound visits those leaves alone that can hold a
fingerprint within the radius: the overlap at shard boundaries. In a leaf, homes and visitors are
compared over all 64 bits. No pair is lost; pairs of a leaf leave it as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import stored
from papershed.llm.components import connected_components
from papershed.llm.similar import near_copies, one_row_each, with_row_key

SHINGLE, SEED, RADIUS, BANDS = 3, 42, 3, 2
#: Bounds of the fit: fingerprints that the first trees are fitted on (expected, by a hash), homes that a leaf should have, sampled
#: fingerprints a leaf. Bounds of the levels below: sampled fingerprints of a level, nodes of all trees, 16 bytes each.
SAMPLE, LEAF, PER_LEAF, DRAWN, NODES = 32_768, 2_048, 8, 2_000_000, 4_000_000
BLOCK = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    h = np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):  # long texts in parts
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``doc_id, fp``, the fingerprint as a signed long, and the string columns in ``keep``. Null counts as no words; other columns are ignored."""
    names = ["doc_id", *keep, "fp"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(fps)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(compute, ", ".join(["doc_id long", *(f"{c} string" for c in keep), "fp long"]))


@dataclass
class Tree:
    """A vantage-point tree over the bits of ``mask``: node i has the children 2i + 1 (near) and 2i + 2 (far)."""

    mask: np.uint64
    depth: int
    vantage: np.ndarray
    median: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, mask: int, depth: int, seed: int = 7) -> Tree:
        n = 2**depth - 1
        tree = Tree(np.uint64(mask), depth, np.zeros(n, np.uint64), np.full(n, 64, np.int64))
        rng = np.random.default_rng(seed)

        def grow(node: int, points: np.ndarray) -> None:
            if node >= n:
                return
            if len(points):
                picks = rng.choice(points, 4)
                tries = [tree._distance(points, v) for v in picks]
                best = int(np.argmax([d.std() for d in tries]))
                tree.vantage[node], d = picks[best], tries[best]
                tree.median[node] = min((abs((d <= m).mean() - 0.5), m) for m in np.unique(d))[1]
                near = d <= tree.median[node]
            else:
                near = np.zeros(0, bool)
            grow(2 * node + 1, points[near])
            grow(2 * node + 2, points[~near])

        grow(0, sample)
        return tree

    def _distance(self, points: np.ndarray, vantage: np.uint64) -> np.ndarray:
        return np.bitwise_count((points ^ vantage) & self.mask).astype(np.int64)

    def leaves(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, points that come there, whether each has its home there)."""
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node >= len(self.vantage):
                yield node - len(self.vantage), at, home
                continue
            d = self._distance(points[at], self.vantage[node])
            near, m = d <= self.median[node], self.median[node]
            for child, inside, reach in ((2 * node + 1, near, d - radius <= m), (2 * node + 2, ~near, d + radius > m)):
                todo.append((child, at[reach], (home & inside)[reach]))


def band_masks(bands: int) -> list[int]:
    edges = [64 * k // bands for k in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _forest(homes: np.ndarray, all_points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (point, root) of the links between homes and larger points.

    A vantage point of the leaf's own orders the points by distance, so that a block of homes
    is compared with the ring that the triangle bound leaves and not with all points.
    """
    pivot = all_points[0]
    ring = np.bitwise_count(all_points ^ pivot).astype(np.int64)
    order = np.argsort(ring, kind="stable")
    points, ring = all_points[order], ring[order]
    parent = np.arange(len(points))
    is_home = np.flatnonzero(np.isin(points, homes))

    def roots(at: np.ndarray) -> np.ndarray:
        while True:
            up = parent[at]
            if np.array_equal(up, at):
                return at
            at = parent[up]

    for b in range(0, len(is_home), BLOCK):
        at = is_home[b : b + BLOCK]
        low, high = np.searchsorted(ring, (ring[at[0]] - radius, ring[at[-1]] + radius + 1))
        close = np.bitwise_count(points[at][:, None] ^ points[low:high][None, :]) <= radius
        close &= points[low:high][None, :] > points[at][:, None]
        for i in np.flatnonzero(close.any(1)):
            linked = roots(np.append(np.flatnonzero(close[i]) + low, at[i]))
            parent[linked] = linked.min()
    top = roots(np.arange(len(points)))
    moved = top != np.arange(len(points))
    return points[moved], points[top[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, leaf: int = LEAF) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of fingerprints within the radius.

    ``distinct`` has one row for each fingerprint ``fp``.
    """

    def compare(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        u, v = _forest(fps[shard.column("home").to_numpy()], fps, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return shards(distinct, radius, bands, leaf).groupBy("leaf").applyInArrow(compare, "u long, v long")


def _below(share: float) -> Column:
    """Whether a fingerprint is drawn: by a hash, so a lost task draws the same ones again."""
    return F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, share))


def shards(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, leaf: int = LEAF) -> DataFrame:
    """``leaf, fp, home``: each fingerprint once for each band where it is at home, and wherever it visits.

    The first trees are fitted on SAMPLE fingerprints. If these can't bear enough leaves, leaves with more than
    ``leaf`` homes get trees of their own, fitted on a sample from each, level by level, until none is
    over-full, can be split, or NODES nodes are reached.
    """
    spark, per_band = distinct.sparkSession, radius // bands
    n = distinct.count()
    sample = np.sort(np.array([r["fp"] for r in distinct.select("fp").filter(_below(SAMPLE / max(1, n))).collect()], dtype=np.int64).view(np.uint64))
    wanted = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    depth = min(wanted, int(np.log2(max(1, len(sample) / PER_LEAF))))
    masks = band_masks(bands)

    def route(trees: dict[int, Tree], width: int):
        """Sends the points of each leaf with a tree to that tree's leaves; other leaves stay as they are."""
        shared = spark.sparkContext.broadcast(trees)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at_leaf = batch.column("leaf").to_numpy()
                points, homes = batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)
                order = np.argsort(at_leaf, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(at_leaf[order]) != 0]) if len(order) else []
                out: list[list[np.ndarray]] = [[], [], []]
                for rows in np.split(order, starts[1:]):
                    if not len(rows):
                        continue
                    old, tree = int(at_leaf[rows[0]]), shared.value.get(int(at_leaf[rows[0]]))
                    found = [(0, np.arange(len(rows)), np.ones(len(rows), bool))] if tree is None else tree.leaves(points[rows], per_band)
                    for new, at, home in found:
                        out[0].append(np.full(len(at), old * width + new, np.int64))
                        out[1].append(points[rows[at]].view(np.int64))
                        out[2].append(home & homes[rows[at]])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["leaf", "fp", "home"])

        return send

    schema = "leaf long, fp long, home boolean"
    per_fp = distinct.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))).alias("leaf"), "fp", F.lit(True).alias("home"))
    routed = per_fp.mapInArrow(route({k: Tree.fit(sample, mask, depth, k) for k, mask in enumerate(masks)}, 2**depth), schema)
    width, nodes, before = 2**depth, bands * 2**depth, None
    while depth < wanted and nodes < NODES:
        routed = stored(routed)
        sizes = routed.filter("home").groupBy("leaf").agg(F.count("*").alias("homes"))
        full = sizes.filter(F.col("homes") > leaf)
        n_full = full.count()
        more = min(wanted - depth, int(np.log2(max(2, DRAWN / PER_LEAF / max(1, n_full)))))
        if not n_full or n_full == before:
            break
        drawn = routed.filter("home").join(F.broadcast(full), "leaf").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) * F.col("homes") < F.lit((1 << 40) * PER_LEAF * 2**more))
        points: dict[int, list[int]] = {}
        for r in drawn.select("leaf", "fp").collect():
            points.setdefault(r["leaf"], []).append(r["fp"])
        trees = {k: Tree.fit(np.sort(np.array(v, np.int64).view(np.uint64)), masks[k // width], more, k) for k, v in points.items()}
        routed = routed.mapInArrow(route(trees, 2**more), schema)
        width, depth, nodes, before = width * 2**more, depth + more, nodes + n_full * 2**more, n_full
    return routed


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Documents link if their fingerprints differ in at most ``radius`` bits; the component id is the
    smallest doc_id that links reach. Texts without words have fingerprint 0 and link
    like any other. Equal fingerprints are one node however many documents have them, so a
    large group of copies adds no pairs. A null doc_id counts only where a component has no
    other; repeated rows have a row each; an empty table gives none.
    """
    own = stored(fingerprints(docs))
    member = _members(own, radius, bands)
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = member.join(smallest, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def _members(own: DataFrame, radius: int, bands: int) -> DataFrame:
    """``fp, first_id, root`` of each distinct fingerprint."""
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(distinct, radius, bands))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """The documents with the smallest doc_id of each component, all columns as they were.

    Each component keeps one row, also where its doc_ids are null or are those of other components too. With a ``similarity`` (a
    Jaccard similarity of shingles) links are those of ``similar.near_copies``, since no radius that trees can
    search holds all pairs of 0.8; without one they are fingerprints within ``radius`` bits.
    """
    if similarity is not None:
        return one_row_each(docs, near_copies(docs, shingle, similarity))
    rows = with_row_key(docs)
    own = stored(fingerprints(rows, shingle, keep=["row_key"]))
    roots = _members(own, radius, bands).select("fp", "root")
    return one_row_each(docs, own.join(roots, "fp").select("doc_id", "row_key", "root"))
