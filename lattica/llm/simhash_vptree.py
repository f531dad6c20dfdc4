"""SimHash near-duplicates, joined through vantage-point trees.

A document's fingerprint is a majority vote of its shingles' XXH64 values. Equal
fingerprints are one point; points are partitioned by a vantage-point tree that is
built from a bounded sample of them. At a node with vantage point v and radius m, a
point x with d(x, v) <= m goes near and one with d(x, v) > m goes far; by the triangle
inequality a partner within r of a far point is beyond m - r, so near points with
d > m - r are also sent far, and every other branch is pruned. Any two points within r
then meet in at least one leaf shard. A shard is one task's work: it is partitioned
further by a tree of its own, in memory, down to leaves that are compared whole. A shard
gives one edge for each member of a local component, so links grow with the documents
and not with the square of a group of copies.

Copies: most distances to a vantage point lie near 32 bits, so each level copies about a
fifth of the points and a tree of L levels sends a point to about 1.2^L shards. Shards
are therefore halved, from ``LARGEST`` points down to ``SHARD``, only as long as the tree
copies a point ``COPIES`` times or less on average (measured on the sample). Where shards
of ``LARGEST`` are copied more often than that, copies grow about as the cube root of the
fingerprints, at 20 bytes each: on random ones 2.9 for a million, 4.0 for ten million, 8.8
for a hundred million and 18.6 for a billion. The tree is bounded by its sample: when
documents outgrow it, shards grow, not the driver, and a shard beyond ``BLOCK`` points is
dealt over pairs of blocks. Points that lie so close together that no vantage point
divides them (a template with a few words that change) are one leaf; beyond ``DENSE`` points
its partners are looked up by changing up to ``RADIUS`` bits of each point (2,080 changes),
so that time grows as n log n and memory with n.

Defined results: a null or empty text has no shingles and fingerprint zero; rows with
equal texts have equal fingerprints; a text of any length is hashed whole, in votes of 32,768
shingles at a time; a row with a null id gets its fingerprint and
takes its component from the documents with ids, or null if none is linked to it;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, in_block_pairs, local_roots, map_arrow, map_groups, saved

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Points in a shard, about, and in a leaf of its own tree; points in a block of a shard that is too large for one task.
SHARD, LEAF, BLOCK = 8192, 1024, 1 << 20
#: Copies of a point, on average, from which shards grow instead, and the points they grow to.
COPIES, LARGEST = 3.0, 1 << 18
#: Points of a leaf from which bit flips are looked up instead of comparing all, and flips that that is worth at most; rows of a tile.
DENSE, PROBES, TILE = 16_384, 4096, 256
#: Fingerprints, at most, that the driver sees to choose vantage points.
SAMPLE = 262_144


def shingles(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 values of the shingles of a UTF-8 text."""
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, dtype=">u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=">u8", count=max(1, len(words) - k + 1))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit majority vote of big-endian hashes, zero without any."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def simhash(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    return majority(shingles(text, k, seed))


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per document; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), k, seed) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, "doc_id long, fp long")


class VantageTree:
    """Nodes as arrays: vantage, radius, near and far child; a leaf has its shard number in ``near`` and -1 in ``far``."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, radius: int):
        self.radius = radius
        self.point, self.cut, self.near, self.far = [], [], [], []
        self.leaves = 0
        points = np.unique(sample)
        self._build(points, total / max(1, len(points)), leaf)

    def _build(self, points: np.ndarray, weight: float, leaf: int) -> int:
        at = len(self.point)
        for xs in (self.point, self.cut, self.near, self.far):
            xs.append(0)
        best = self._split(points) if len(points) * weight > leaf and len(points) >= 16 else None
        if best is None:
            self.near[at], self.far[at] = self.leaves, -1
            self.leaves += 1
            return at
        vantage, cut, d = best
        self.point[at], self.cut[at] = vantage, cut
        self.near[at] = self._build(points[d <= cut], weight, leaf)
        self.far[at] = self._build(points[d > cut - self.radius], weight, leaf)
        return at

    def _split(self, points: np.ndarray):
        """The vantage and radius that copy the fewest points for what they divide, while both sides shrink."""
        best, least = None, np.inf
        some = points[:: max(1, len(points) // 2048)]
        for v in points[:: max(1, len(points) // 12)][:12]:
            within = np.bincount(np.bitwise_count(some ^ v), minlength=65).cumsum() / len(some)  # share of points within each distance
            near, far = within[self.radius : 64], 1 - within[: 64 - self.radius]
            fits = np.flatnonzero((np.maximum(near, far) <= 0.8) & (np.minimum(near, far) > 0))
            if not len(fits):
                continue
            near, far = near[fits], far[fits]
            cost = np.log(near + far) / -(near * np.log(near) + far * np.log(far))
            if cost.min() < least:
                best, least = (v, int(fits[cost.argmin()]) + self.radius), cost.min()
        if best is None:
            return None
        return best[0], best[1], np.bitwise_count(points ^ best[0]).astype(np.int64)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard that a point must be in."""
        rows, shards, todo = [], [], [(0, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if self.far[at] < 0:
                rows.append(own)
                shards.append(np.full(len(own), self.near[at]))
                continue
            d = np.bitwise_count(points[own] ^ np.uint64(self.point[at])).astype(np.int64)
            todo += [(self.near[at], own[d <= self.cut[at]]), (self.far[at], own[d > self.cut[at] - self.radius])]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(shards)


def _leaf_roots(fp: np.ndarray, own: np.ndarray | None, radius: int) -> np.ndarray:
    """Each point's smallest index of its component in a leaf; with ``own`` only points of different blocks are compared."""

    def rows(at: int) -> np.ndarray:
        near = np.bitwise_count(fp[at : at + 256, None] ^ fp) <= radius
        return near if own is None else near & (own[at : at + 256, None] != own)

    n = len(fp)
    if n <= 2 * LEAF:
        linked = np.empty((n, n), dtype=bool)
        for at in range(0, n, 256):
            linked[at : at + 256] = rows(at)
        some = np.flatnonzero(linked.sum(axis=1) > (own is None))
        root = np.arange(n)
        root[some] = some[local_roots(linked[np.ix_(some, some)])]
        return root
    # a dense leaf, which no vantage point divides
    masks = flips(radius) if sum(comb(64, k) for k in range(radius + 1)) <= PROBES else None
    return _probed(fp, own, masks) if masks is not None and n > DENSE else _tiled(fp, own, radius)


def flips(radius: int) -> np.ndarray:
    """All values with 1 to ``radius`` of 64 bits, fewer bits first."""
    return np.array([sum(1 << b for b in bits) for k in range(1, radius + 1) for bits in combinations(range(64), k)], dtype=np.uint64)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i], for every i; a root is the smallest member that is known."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _probed(fp: np.ndarray, own: np.ndarray | None, masks: np.ndarray) -> np.ndarray:
    """Components by looking up every point, all of them different, with each mask's bits changed: n
    log n steps a mask, and a few numbers a point of memory, however many points are near each other."""
    order = np.argsort(fp)
    held, root = fp[order], np.arange(len(fp))
    for m in masks:
        other = held ^ m
        up = other > held  # each pair once
        at = np.searchsorted(held, other[up])
        hit = at < len(held)
        hit[hit] = held[at[hit]] == other[up][hit]
        a, b = order[np.flatnonzero(up)[hit]], order[at[hit]]
        if own is not None:
            a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        _joined(root, a, b)
    return root


def _tiled(fp: np.ndarray, own: np.ndarray | None, radius: int) -> np.ndarray:
    """Components by comparing tiles of the points with each other, nothing of which is kept."""
    n = len(fp)
    root = np.arange(n)
    while True:
        before = root.copy()
        for at in range(0, n, TILE):
            for to in range(0, n, 16 * TILE):
                near = np.bitwise_count(fp[at : at + TILE, None] ^ fp[to : to + 16 * TILE]) <= radius
                if own is not None:
                    near &= own[at : at + TILE, None] != own[to : to + 16 * TILE]
                least = np.where(near, root[to : to + 16 * TILE], n).min(axis=1)
                root[at : at + TILE] = np.minimum(root[at : at + TILE], least)
        root = root[root]
        if (root == before).all():
            return root


def _compared(radius: int, leaf: int):
    """Edges of one shard, or of one pair of blocks of it: one for each member of a local component but its root."""

    def run(t: pa.Table) -> pa.Table:
        across = t["block_i"][0].as_py() != t["block_j"][0].as_py()
        t = t.sort_by("node")
        fp, node = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy()
        own = t["own"].to_numpy() if across else None
        points, shards = VantageTree(fp, len(fp), leaf, radius).route(fp)
        order = np.lexsort((points, shards))
        edges = []
        for part in np.split(points[order], np.flatnonzero(np.diff(shards[order])) + 1):
            root = part[_leaf_roots(fp[part], None if own is None else own[part], radius)]
            far = np.flatnonzero(root != part)
            edges.append(np.stack([node[part[far]], node[root[far]]]))
        a, b = np.unique(np.concatenate(edges, axis=1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def fitted(sample: np.ndarray, total: int, radius: int, shard: int = SHARD, copies: float = COPIES, largest: int = LARGEST) -> tuple[VantageTree, float]:
    """The tree with the smallest shards that copies a point at most ``copies`` times on average, and how often it does."""
    probe = np.unique(sample)[:: max(1, len(sample) // 20_000)]
    best, size = None, max(shard, largest)
    while True:
        tree = VantageTree(sample, total, size, radius)
        factor = len(tree.route(probe)[0]) / max(1, len(probe))
        if best is None or factor <= copies:
            best = tree, factor
        if factor > copies or size <= shard:
            return best
        size = max(shard, size // 2)


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK, copies: float = COPIES) -> DataFrame:
    """Edges (a, b) that connect exactly the ``node``s whose ``fp`` are joined by chains
    of points within ``radius`` bits. ``points``: written table of distinct fps."""
    spark = points.sparkSession
    total = points.count()
    some = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(max(4, -(-total // sample)))) == 0) if total > shard else points.limit(0)
    tree, _ = fitted(np.array([r.fp for r in some.collect()], dtype=np.int64).view(np.uint64), total, radius, shard, copies)
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            rows, shards = shared.value.route(fp.view(np.uint64))
            for at in range(0, len(rows), 100_000):
                own = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(shards[at : at + 100_000].astype(np.int32)), pa.array(fp[own]), pa.array(b.column("node").to_numpy()[own])], ["shard", "fp", "node"])

    routed = saved(map_arrow(points.select("fp", "node"), run, "shard int, fp long, node long"))
    sizes = F.broadcast(routed.groupBy("shard").agg(F.count("*").alias("size")))  # a row for each leaf of the tree, which the driver has built
    dealt = in_block_pairs(routed.join(sizes, "shard"), "size", "node", block)
    return map_groups(dealt, ["shard", "block_i", "block_j"], _compared(radius, leaf), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = saved(fingerprints(docs))
    points = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("node", F.col("fp")))  # a fingerprint stands for itself, as its rows may have no id
    labels = components(links(points, radius))
    least = labels.join(points.select("node", "id"), "node").groupBy(F.col("label").alias("root")).agg(F.min("id").alias("least"))
    named = points.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).join(least, "root", "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("least", "id").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def op1_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component over the whole table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
