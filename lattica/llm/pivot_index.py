"""Near-duplicates of embeddings through a pivot-permutation index.

Pivots are a bounded sample of the vectors, without those near an earlier one, so that a
large group of near-equal vectors holds a pivot or two and its members have the same
nearest pivots, and not their own noise's. Every vector is described by the ordered list
of its nearest pivots and enters the inverted list of each of them, apart by label. Lists
of pivots that lie near each other are kept together as one group, so that a vector, whose
nearest pivots are neighbours, is copied to about half as many groups as it has lists. In a
list, shared pivots are counted first: two vectors with at least ``SHARED`` are candidates,
in the list of the smallest pivot that they share and nowhere else. Candidates, and only
they, are verified by cosine in double precision. No pairs are put out: a group of lists
gives each member its number of links and one edge to the root of its local component.

Equal vectors of one label are one class with a multiplicity. The number of pivots grows
with the classes up to ``MOST_PIVOTS``. Beyond that many classes a list is kept for each
pair of pivots instead (the two smallest that two vectors share): the same candidates,
in lists that are shorter by orders of magnitude, for as many entries as pairs. Groups and
lists of over ``BLOCK`` members are compared in pairs of blocks, so no task holds more
than two blocks.

Recall: two vectors at cosine 0.935 share 2 of the nearest pivots with a frequency of 1.000
for 256 pivots (8 nearest), 1.000 for 1,024 and 0.999 for 4,096 (10 nearest), measured on
1,500 perturbations of test vectors; the tests measure it against brute force.

Defined results: a vector that is null, empty, zero or holds null or non-finite components,
or has a null label, links with nothing; vectors of different lengths are not linked;
repeated rows are vectors of their own and link with each other; rows with a null id count
as links but get a null component and are not kept; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, in_block_pairs, local_roots, map_arrow, map_groups, saved

COSINE = 0.93
SHARED = 2
#: Nearest pivots of a vector, and from how many pivots on it is described by the second number of them.
NEAREST, MANY = (8, 10), 512
#: Vectors for each pivot, about, and bounds of the number of pivots; pivots in a group of lists, about.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, GROUP = 200, 32, 4096, 12
#: The cosine from which two pivots are near, and vectors that are looked at for each pivot.
APART, LOOKED_AT = 0.8, 4
#: Rows compared at once, and one in how many of their pairs must be a candidate for a product of matrices to verify them.
ROWS, DENSE = 256, 8
BLOCK = 4096
#: Sizes of lists, at most, that are broadcast.
SIZES = 100_000


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _separated(unit: np.ndarray, apart: float, most: int) -> np.ndarray:
    """The first ``most`` vectors that are nowhere within a cosine of ``apart`` of one before that is kept."""
    kept = np.empty((min(most, len(unit)), unit.shape[1]))
    n = 0
    for v in unit:
        if n < len(kept) and not (kept[:n] @ v >= apart).any():
            kept[n] = v
            n += 1
    return kept[:n]


class Pivots:
    """Pivots of the vectors of one length, and the group of each, which is that of its nearest head."""

    def __init__(self, sample: np.ndarray, most: int, nearest: int):
        self.points = _separated(_unit(sample), APART, most)
        self.nearest = min(nearest, len(self.points))
        self.group = (self.points @ self.points[: max(1, len(self.points) // GROUP)].T).argmax(axis=1)

    def described(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's nearest pivots in their order."""
        near = _unit(vectors) @ self.points.T
        top = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _described(pivots: dict[int, Pivots]):
    """Each vector with its permutation prefix and the groups of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("vector").value_lengths().to_numpy()
            for d in np.unique(lengths):
                rows = b.take(pa.array(np.flatnonzero(lengths == d)))
                for at in range(0, rows.num_rows, 2048):
                    part = rows.slice(at, 2048)
                    # a length that the sample lacks has one list
                    own = pivots.get(int(d)) or Pivots(np.ones((1, d)), 1, 1)
                    order = own.described(_matrix(part.column("vector")))
                    homes = np.sort(own.group[order], axis=1)
                    first = np.hstack([np.ones((len(homes), 1), dtype=bool), homes[:, 1:] != homes[:, :-1]])
                    ends = np.append(0, first.sum(axis=1).cumsum())
                    held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(homes[first].astype(np.int32)))
                    prefix = pa.FixedSizeListArray.from_arrays(pa.array(order.astype(np.int32).ravel()), order.shape[1]).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("node"), part.column("n"), part.column("vector"), prefix, held], ["label", "node", "n", "vector", "prefix", "homes"])

    return run


def _verified(pivots: dict[int, Pivots], cosine: float, shared: int):
    """Links and edges of one pair of blocks of a group of lists (``second`` -1) or of the list of a pair of pivots."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        home, second = t["home"][0].as_py(), t["second"][0].as_py()
        across = t["block_i"][0].as_py() != t["block_j"][0].as_py()
        unit, prefix, own = _unit(_matrix(t["vector"])), _matrix(t["prefix"]), t["own"].to_numpy()
        node, n = t["node"].to_numpy(), t["n"].to_numpy()
        least = min(shared, prefix.shape[1])
        names, at, times = np.unique(prefix, return_inverse=True, return_counts=True)
        held = np.zeros((len(node), len(names)), dtype=np.float32)
        np.put_along_axis(held, at.reshape(prefix.shape), 1, axis=1)
        if second >= 0:
            mine = np.flatnonzero(names == home)
        else:
            group = pivots[unit.shape[1]].group[names] if unit.shape[1] in pivots else np.zeros(len(names), dtype=int)
            mine = np.flatnonzero((group == home) & (times > 1))
        linked = np.zeros((len(node), len(node)), dtype=bool)
        for p in mine:  # the inverted list of one pivot
            rows = np.flatnonzero(held[:, p])
            some = held[rows]
            keep = some.sum(axis=0) > 1  # what one member has is shared by none
            before, every = some[:, keep & (np.arange(len(names)) < p)], some[:, keep]
            between = some[:, keep & (np.arange(len(names)) > p) & (names < second)]
            for a in range(0, len(rows), ROWS):
                found = (every[a : a + ROWS] @ every.T >= least) & (before[a : a + ROWS] @ before.T == 0)
                if second >= 0:
                    found &= between[a : a + ROWS] @ between.T == 0
                found &= np.arange(a, min(a + ROWS, len(rows)))[:, None] < np.arange(len(rows))
                if across:
                    found &= own[rows[a : a + ROWS], None] != own[rows]
                if np.count_nonzero(found) * DENSE > found.size:
                    found &= unit[rows[a : a + ROWS]] @ unit[rows].T >= cosine
                    i, j = np.nonzero(found)
                else:
                    i, j = np.nonzero(found)
                    close = [np.einsum("ij,ij->i", unit[rows[i[k : k + 20_000] + a]], unit[rows[j[k : k + 20_000]]]) >= cosine for k in range(0, len(i), 20_000)]
                    good = np.concatenate(close) if close else np.zeros(0, dtype=bool)
                    i, j = i[good], j[good]
                linked[rows[i + a], rows[j]] = True
        linked |= linked.T
        some = np.flatnonzero(linked.any(axis=1))
        links = linked[np.ix_(some, some)]
        counts = links @ n[some]
        np.fill_diagonal(links, True)
        root = node[some][local_roots(links)] if len(some) else node[some]
        return pa.table({"node": pa.array(node[some], pa.int64()), "links": pa.array(counts.astype(np.int64)), "root": pa.array(root, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, nearest: int | None = None, shared: int = SHARED, paired: bool | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    ``paired``: lists by pairs of pivots; by default where classes outnumber what single
    lists of the most pivots should hold. The rows found are the same.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # floats are doubles of half the size
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # a class is a label and a vector, known from here on by two hashes of them
    clean = rows.select("vec_id", F.when(usable, F.concat_ws(":", "label", F.size("vector"))).alias("label"), F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))).alias("vector"))
    told = saved(clean.withColumns({"c1": F.xxhash64("label", "vector"), "c2": F.xxhash64(F.lit("second"), "label", "vector")}))
    classes = saved(told.where("label is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("node", F.coalesce("id", F.lit(-1) - F.abs(F.col("c1") / 4).cast("long"))))  # a stand-in where no row has an id
    total = classes.count()
    wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, ceil(total / PER_PIVOT)))
    paired = total > MOST_PIVOTS * PER_PIVOT if paired is None else paired
    links = _links(classes, wanted, cosine, nearest or NEAREST[wanted > MANY], shared, paired and shared >= 2, kind)
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # where a stand-in is the smallest of its component, the smallest id is the label
    renamed = classes.select("id", "node").join(roots, "node").groupBy("label").agg(F.min("id").alias("own")).where("own is null or own <> label").select(F.col("label").alias("root"), "own", F.lit(True).alias("other"))
    named = classes.select("c1", "c2", "id", "node", "n").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("label", "node")).join(renamed, "root", "left")
    component = F.when(F.col("other"), F.col("own")).when(F.col("label").isNull(), F.col("id")).otherwise(F.col("root"))
    named = saved(named.select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), component.alias("component")))
    out = told.select("vec_id", "c1", "c2", F.col("label").isNotNull().alias("usable")).join(named, ["c1", "c2"], "left")
    component = F.when(F.col("usable") & F.col("vec_id").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pivot_pairs(prefix: str):
    """All pairs (pivot < second) of a description."""
    p = F.array_sort(prefix)
    after = lambda i: F.slice(p, i + 2, F.size(p))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.transform(after(i), lambda q: F.struct(F.get(p, i).alias("home"), q.alias("second")))))


def _links(classes: DataFrame, most: int, cosine: float, nearest: int, shared: int, paired: bool, kind: str = "double") -> DataFrame:
    """(node, links, root), written: what the inverted lists say of their members."""
    sample = classes.select("vector").orderBy(F.xxhash64("node", F.lit("pivot")), "node").limit(LOOKED_AT * most).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    pivots = {d: Pivots(np.array(x, dtype=np.float64), most, nearest) for d, x in by_size.items()}
    lists = saved(map_arrow(classes.select("label", "node", "n", "vector"), _described(pivots), f"label string, node long, n long, vector array<{kind}>, prefix array<int>, homes array<int>"))
    single = F.transform("homes", lambda h: F.struct(h.alias("home"), F.lit(-1).alias("second")))
    entries = F.when(F.size("prefix") >= 2, _pivot_pairs("prefix")).otherwise(single) if paired else single
    key = ["label", "home", "second"]
    held = lists.select("label", "node", "n", "vector", "prefix", F.inline(entries))
    sizes = saved(held.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"))
    dealt = in_block_pairs(held.join(F.broadcast(sizes) if sizes.count() <= SIZES else sizes, key), "size", "node", BLOCK)
    return saved(map_groups(dealt, [*key, "block_i", "block_j"], _verified(pivots, cosine, shared), "node long, links long, root long"))


def op3_pivot_permutations(spark, sf_dir: str) -> DataFrame:
    """Every vector's number of links and component, over the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), linked AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN linked ON e.vec_id = linked.a
"""
