"""Near copies by the Jaccard similarity of their word shingles.

Equal shingle sets are one class. SimHash fingerprints in vantage-point trees give the
first candidates, which join most members of a large group by one edge each. What they
miss is found by prefixes: two sets with a similarity of s or more share one of the first
n - ceil(s n) + 1 shingles of each in any common order. The order here has the commonest
shingles last and is that of the hashes else, so that a passage that many documents share
makes candidates only of documents that hold little besides. In the list of a shingle
every member is held against one or two of another component, the same in most lists,
and when that joins no more, against all that are still apart, in pairs of blocks. A candidate whose sizes or folded
sets (parities of 1,024 buckets, for long documents of at least four for each shingle,
which differ in no more places than the sets differ in shingles) rule similarity out
goes; all others are verified on the whole sets, so the components are exactly those of
all pairs.

Only prefixes, a fifth of the shingles, are kept for all documents; the whole sets are
made again from the text of those that are verified. The order holds for any list of
common shingles, so its bound (``COMMON``) costs time and no results.

Defined results: words are those of ``simhash``; a text of fewer words than a shingle is
one shingle; texts without words are copies of each other; rows with a null id are left
out, those of one id are one document; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash_vptree import links, majority, shingles
from .store import components, dropped, in_block_pairs, map_arrow, saved

SHINGLE = 5
#: The least similarity, 4/5, in whole numbers.
PART, WHOLE = 4, 5
#: Rounds, at most, against one member of a list, and members of its lists that a class meets in a round.
ROUNDS, HUBS = 2, 2
#: Common shingles, at most, that the order knows; shingles that are counted at once, and the part of a chunk's documents that makes one common.
COMMON, CHUNK, OFTEN = 65_536, 4_000_000, 512
#: Bits of a folded set; sets of more shingles than that have a wide one too, of ``WIDE`` bits a shingle at least.
FOLD, WIDE = 1024, 4
#: Ids, at most, that are broadcast (16 MB); more are joined by a shuffle of the documents.
BROADCAST = 2_000_000
#: Members of a list that are compared in one block.
BLOCK = 2048


def _sets(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, shingle hashes and sorted distinct shingle hashes of each text."""
    for i, t in enumerate(b.column("text")):
        h = shingles(t.as_py(), k)
        yield i, h, np.unique(h.astype(np.uint64))


def _node(grams: np.ndarray) -> int:
    """The signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))


def _folded(grams: np.ndarray, bits: int = FOLD) -> np.ndarray:
    """Parities of the number of shingles in each of ``bits`` (a power of two) buckets, as longs."""
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) & bits - 1, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _often(chunk: list[np.ndarray]) -> pa.RecordBatch:
    """The shingles that many of the sets hold, with the number of those."""
    grams, times = np.unique(np.concatenate(chunk), return_counts=True)
    some = times >= max(4, len(chunk) // OFTEN)
    n = int(some.sum())
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*none, pa.array(grams[some].view(np.int64)), pa.array(times[some])], _NAMES)


_NAMES = ["doc_id", "node", "n", "fp", "fold", "wide", "gram", "times"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _told(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: set (as a hash), size, fingerprint and folded set; and rows of common shingles (gram, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for b in batches:
            node, n, fp, fold, wide = [], [], [], [], []
            for _, h, grams in _sets(b, k):
                node.append(_node(grams))
                n.append(len(grams))
                fp.append(majority(h))
                fold.append(_folded(grams))
                wide.append(_folded(grams, 1 << (WIDE * len(grams) - 1).bit_length()) if len(grams) > FOLD else None)
                chunk.append(grams)
                held += len(grams)
                if held > CHUNK:
                    yield _often(chunk)
                    chunk, held = [], 0
            if node:
                folds = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(fold)), FOLD // 64).cast(pa.list_(pa.int64()))
                fps = pa.array(np.array(fp, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), fps, folds, pa.array(wide, pa.list_(pa.int64())), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], _NAMES)
        if chunk:
            yield _often(chunk)

    return map_arrow(_rows(docs), run, "doc_id long, node long, n int, fp long, fold array<long>, wide array<long>, gram long, times long")


def _least(n: int) -> int:
    """The least overlap of a set of ``n`` with one that is similar."""
    return -(-n * PART // WHOLE)


def _grams(docs: DataFrame, k: int, cut: bool, common: list | None = None) -> DataFrame:
    """(node, n, grams): the whole set, or with ``cut`` its prefix in the order that has ``common`` (gram, times) last."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted((g & (1 << 64) - 1, t) for g, t in common or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([g for g, _ in shared.value], dtype=np.uint64)
        times = np.array([t for _, t in shared.value], dtype=np.int64)
        for b in batches:
            node, n, got = [], [], []
            for i, _, grams in _sets(b, k):
                node.append(_node(grams))
                n.append(len(grams))
                if cut and len(grams):
                    weight = np.zeros(len(grams), dtype=np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                        weight = np.where(known[at] == grams, times[at], 0)
                    grams = grams[np.lexsort((grams, weight))[: len(grams) - _least(len(grams)) + 1]]
                got.append(grams)
                if len(got) == 256 or i == b.num_rows - 1:
                    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), held], ["node", "n", "grams"])
                    node, n, got = [], [], []

    return map_arrow(_rows(docs), run, "node long, n int, grams array<long>")


def with_ids(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the ids of a written table
    of distinct ``doc_id``: by a broadcast up to ``BROADCAST`` ids, else by a shuffle."""
    few = ids.count() <= BROADCAST
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", kind)


def _differ(a: Column, b: Column) -> Column:
    """The places in which two folded sets of one size differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _halved(a: Column, b: Column) -> Column:
    """The folded set ``a``, folded once more if it is larger than ``b`` (twice as large: the sets are near in size)."""
    half = (F.size(a) / 2).cast("int")
    return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)


class _Verifier:
    """Verifies candidate pairs of classes of near sizes on their whole sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int):
        self.docs, self.classes, self.k = docs, classes, k

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, written."""
        a, b = (self.classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("fold").alias(f"{x}_fold"), F.col("doc_id").alias(f"{x}_id")) for x in "ab")
        once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        most = (F.col("a_n") + F.col("b_n")) * (WHOLE - PART)
        first = once.join(a, "a").join(b, "b").where(_near_sizes("a_n", "b_n")).where(_differ(F.col("a_fold"), F.col("b_fold")) * (PART + WHOLE) <= most)
        first = saved(first.select("a", "b", "a_id", "b_id", "a_n", "b_n"))
        a, b = (self.classes.where("wide is not null").select(F.col("node").alias(x), F.col("wide").alias(f"{x}_wide")) for x in "ab")
        wide = first.where(F.least("a_n", "b_n") > FOLD).join(a, "a").join(b, "b")
        apart = _differ(_halved(F.col("a_wide"), F.col("b_wide")), _halved(F.col("b_wide"), F.col("a_wide")))
        near = saved(first.where(F.least("a_n", "b_n") <= FOLD).select("a", "b", "a_id", "b_id").union(wide.where(apart * (PART + WHOLE) <= most).select("a", "b", "a_id", "b_id")))
        ids = saved(near.select(F.col("a_id").alias("doc_id")).union(near.select("b_id")).distinct())
        sets = saved(_grams(with_ids(self.docs, ids, "left_semi"), self.k, cut=False).dropDuplicates(["node"]))
        x, y = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
        both = near.select("a", "b").join(x, "a").join(y, "b")
        common, every = F.size(F.array_intersect("a_grams", "b_grams")), F.size("a_grams") + F.size("b_grams")
        out = saved(both.where(common * (PART + WHOLE) >= every * PART).select("a", "b"))
        for t in (first, near, ids, sets):
            dropped(t)
        return out


def _near_sizes(a: str, b: str):
    return (F.col(a) * WHOLE >= F.col(b) * PART) & (F.col(b) * WHOLE >= F.col(a) * PART)


def _lists(prefixes: DataFrame) -> DataFrame:
    """(gram, node, n, central), written: the shingles that prefixes of several classes share,
    and what part of its set that is for each class: most for the one that a group's others are edits of."""
    every = prefixes.select("node", "n", F.explode("grams").alias("gram"))
    # written, as every aggregate that meets hot shingles: adaptive execution splits a join's side only straight after an exchange of its own
    several = saved(every.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("gram"))
    shared = every.join(several, "gram").select("gram", "node", "n")
    out = saved(shared.withColumn("central", F.count("*").over(Window.partitionBy("node")) / F.col("n")))
    dropped(several)
    return out


def _apart(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """The lists with the component of each member, written."""
    labels = components(edges)
    return saved(lists.join(labels, "node", "left").select("gram", "node", "n", "central", F.coalesce("label", "node").alias("part")))


def _open(at: DataFrame, turn: int) -> DataFrame:
    """(gram, size, hub), written: the lists that hold several components, with their length and
    one member: the most central one at first, later ones more and more at random."""
    chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000)) * F.lit(0.0002 * turn)
    several = at.groupBy("gram").agg(F.count("*").alias("size"), F.max_by(F.struct("node", "n", "part"), F.struct((F.col("central") + chance).alias("c"), "node")).alias("hub"), F.max(F.col("central") + chance).alias("c"), F.min("part").alias("low"), F.max("part").alias("high"))
    return saved(several.where("low < high").select("gram", "size", "hub", "c"))


def near_copies(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` with an id, as a written table."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    every = saved(_told(docs, k))
    common = every.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(COMMON).collect()
    told = every.where("node is not null").select("doc_id", "node", "n", "fp", "fold", "wide")
    # a class's set is that of any of its rows
    classes = saved(told.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fold").alias("fold"), F.first("wide").alias("wide")))
    others = saved(told.select("doc_id").distinct().join(classes.select("doc_id"), "doc_id", "left_anti"))
    verified = _Verifier(docs, classes, k)
    full = classes.where("n > 0")
    points = saved(full.groupBy("fp").agg(F.min("node").alias("node")))
    heads = full.select(F.col("node").alias("a"), "fp").join(points.withColumnRenamed("node", "b"), "fp").select("a", "b")
    edges = verified(links(points).union(heads))
    prefixes = saved(_grams(with_ids(docs, others, "left_anti"), k, cut=True, common=[(r.gram, r.times) for r in common]))
    lists = _lists(prefixes)
    dropped(prefixes)
    at = _apart(lists, edges)
    for turn in range(ROUNDS):
        several = _open(at, turn)
        hub = several.select("gram", "c", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.part").alias("other"))
        met = at.join(hub, "gram").where(F.col("part") != F.col("other")).where(_near_sizes("n", "m"))
        # a class has a hub for each shingle of its prefix at most; the same few come first in all lists
        few = F.slice(F.sort_array(F.collect_set(F.struct("c", "b")), False), F.lit(1), F.lit(HUBS))
        found = verified(met.groupBy(F.col("node").alias("a")).agg(few.alias("hubs")).select("a", F.explode("hubs.b").alias("b")))
        dropped(several)
        if not found.limit(1).count():
            break
        edges = edges.union(found)
        dropped(at)
        at = _apart(lists, edges)
    several = _open(at, 0)
    left = at.join(several.select("gram", "size"), "gram").join(full.select("node", "fold"), "node")
    dealt = saved(in_block_pairs(left, "size", "node", BLOCK))
    mine, other = dealt.select("gram", "block_i", "block_j", "node", "n", "part", "own", "fold"), dealt.select("gram", "block_i", "block_j", F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"), F.col("own").alias("own_b"), F.col("fold").alias("fold_b"))
    rest = mine.join(other, ["gram", "block_i", "block_j"]).where("part < other and (block_i = block_j or own <> own_b)").where(_near_sizes("n", "m"))
    rest = rest.where(_differ(F.col("fold"), F.col("fold_b")) * (PART + WHOLE) <= (F.col("n") + F.col("m")) * (WHOLE - PART))  # within the join: no pair is put out that sizes or folds rule out
    labels = components(edges.union(verified(rest.select(F.col("node").alias("a"), "b"))))
    named = classes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = saved(told.select("doc_id", "node").join(named.select("node", "label"), "node").join(least, "label").select("doc_id", "component_id"))
    for t in (every, classes, others, points, lists, at, several, dealt):
        dropped(t)
    return out
