"""Alignment of two tokenizers over a corpus, by a cogroup of postings.

The A and the B tokens of a text both cover space+text. Offsets at which both end cut them
into groups, and an A and a B occurrence are linked if their byte ranges overlap. The
count of an id pair is the number of documents that hold it linked.

1. Where a text lies, it is tokenised both ways and its linked pairs are folded to
   postings (pair, times in the document), kept packed in one written row a document.
2. Partial counts (of the postings in a task) are summed by pair, and the highest count
   of an A id is taken over its pairs, of which it has a vocabulary at most.
3. Postings are shuffled by side id: ranges of A ids of about equal weight, a heavy range
   (one frequent id may hold a third of all postings) dealt over salts by document. Each
   salt gets the counts of its range. The shuffle's sort, which spills, brings a group's
   counts before its postings; a worker holds the counts of one range and streams the
   postings past them, putting out what each document gets from them.
4. Those contributions are summed by document.

Tokenising goes by units, which single spaces with other characters on both sides
separate: no token of either kind crosses them (``Aligner`` refuses vocabularies in which
one could). A worker keeps what it found for the units it met first, up to ``UNITS``, and
tokenises the others in runs; long texts go through in slices.

Defined results: each row is a document, repeated or not, with or without id; a null or
empty text, and one whose tokens do not spell space+text, has no tokens (zeros and ''); a
text of any length is aligned whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import map_arrow, saved

#: Units that a worker remembers, characters in a slice of a text, units tokenised together.
UNITS, SLICE, RUN = 400_000, 1 << 20, 4096
#: Ranges of A ids, postings for a salt at least, postings in a packed row and before a flush.
RANGES, GROUP, ROW, FLUSH = 16, 1 << 20, 1 << 14, 1 << 22
#: A salt's postings are so many times the counts that are copied to it, at least.
WORTH = 4

ODD = re.compile("[^\\S \n]|᠎")
BOUNDARY = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
BARE = re.compile("[^\\s᠎](?:.*[^\\s᠎])?", re.DOTALL)

ALIGNED = "doc_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
PACKED = "range int, salt int, kind int, docs binary, sizes binary, pairs binary, times binary"
COUNTS, POSTINGS = 0, 1


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary spells bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """The parts of a text between boundaries; joined by spaces they are the text."""
    plain = not (text[:1].isspace() or text[-1:].isspace() or "  " in text or " \n" in text or "\n " in text or ODD.search(text))
    return text.split(" ") if plain else BOUNDARY.split(text)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of ``size`` characters or a little more, cut at boundaries."""
    at = 0
    while len(text) - at > size and (m := BOUNDARY.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Aligner:
    """What the two tokenizers make of units: counts, linked pairs and the text of the groups."""

    def __init__(self, path_a: str, path_b: str, limit: int = UNITS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters.get(c, 63) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of several words cross the boundaries of units")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # each token as text, and what follows it: (",", "|") in A, (",", ";") in B
        self.said = [[f"{i}{c}" for i in range(len(t))] for t, c in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"))]
        self.limit = limit
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.count = np.zeros((1024, 4), dtype=np.int64)
        self.first = np.zeros(1024, dtype=np.int64)
        self.pairs, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def learn(self, new: list[str]) -> None:
        bare = [u for u in new if BARE.fullmatch(u)]
        for k in range(0, len(bare), RUN):
            self._learn(bare[k : k + RUN])
        for u in set(new).difference(bare):
            self._learn([u])

    def _learn(self, run: list[str]) -> None:
        """A run of units, tokenised as one text; in halves, if its tokens do not spell it."""
        raw = [b" " + u.encode() for u in run]
        ids_a = np.array(self.a.encode(" " + " ".join(run), add_special_tokens=False).ids, dtype=np.int64)
        ids_b = np.array(self.b.encode(" ".join(run)), dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        ends = np.cumsum([len(x) for x in raw])
        whole = b"".join(raw)
        same = all(b"".join(map(t.__getitem__, ids.tolist())) == whole for t, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        if not same or not (np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            if len(run) == 1:
                self._keep(run, np.zeros((1, 4), dtype=np.int64), np.zeros(0, dtype=np.uint32), [None])
            else:
                self._learn(run[: len(run) // 2])
                self._learn(run[len(run) // 2 :])
            return
        both = np.intersect1d(ends_a, ends_b)
        of_a, of_b, of_group = (np.searchsorted(ends, x) for x in (ends_a, ends_b, both))
        # the B tokens that an A token overlaps stand side by side
        low = np.searchsorted(ends_b, ends_a - self.length_a[ids_a], side="right")
        n = np.searchsorted(ends_b, ends_a) - low + 1
        second = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        pairs = (np.repeat(ids_a, n) << 16 | ids_b[second]).astype(np.uint32)
        size = len(run)
        count = np.stack([np.bincount(x, w, size) for x, w in ((of_a, None), (of_b, None), (of_group, None), (of_a, n))], axis=1).astype(np.int64)
        said: list[str] = []
        at_a, at_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        (comma_a, bar, comma_b, semicolon), list_a, list_b = self.said, ids_a.tolist(), ids_b.tolist()
        i = j = 0
        for to_a, to_b in zip(at_a.tolist(), at_b.tolist(), strict=True):
            said.append("".join([*[comma_a[x] for x in list_a[i : to_a - 1]], bar[list_a[to_a - 1]], *[comma_b[x] for x in list_b[j : to_b - 1]], semicolon[list_b[to_b - 1]]]))
            i, j = to_a, to_b
        cut = [0, *np.cumsum(count[:, 2]).tolist()]
        self._keep(run, count, pairs, ["".join(said[x:y]) for x, y in zip(cut, cut[1:])])

    def _keep(self, run: list[str], count: np.ndarray, pairs: np.ndarray, groups: list[str | None]) -> None:
        at, to = len(self.groups), len(self.groups) + len(run)
        while to > len(self.first):
            self.count, self.first = np.concatenate([self.count, np.zeros_like(self.count)]), np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.count[at:to] = count
        self.first[at:to] = self.used + np.cumsum(count[:, 3]) - count[:, 3]
        self.pairs[self.used : self.used + len(pairs)] = pairs
        self.used += len(pairs)
        self.groups += groups
        self.known.update(zip(run, range(at, to)))

    def aligned(self, texts: list[str]) -> Iterator[tuple[tuple[int, ...], str, np.ndarray, np.ndarray]]:
        """For each text the counts, the digest of the groups, the linked pairs, ascending, and their times."""
        parts = [units(t) for t in texts]
        before, used = len(self.groups), self.used
        new = set().union(*parts).difference(self.known)
        if new:
            self.learn(sorted(new))
        for part in parts:
            at = np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))
            said = [self.groups[k] for k in at.tolist()]
            if None in said:
                yield None
                continue
            n = self.count[at, 3]
            where = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
            pairs, times = np.unique(self.pairs[where], return_counts=True)
            yield tuple(self.count[at].sum(axis=0).tolist()), "".join(said), pairs, times
        if len(self.groups) > self.limit:
            for u in new:
                del self.known[u]
            del self.groups[before:]
            self.used = used

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """(counts, digest, pairs, times) of each text, or None if it has no tokens."""
        found: list[tuple | None] = []
        block: list[str] = []

        def flush() -> None:
            for x in self.aligned(block):
                found.append(x and (x[0], hashlib.sha256(x[1][:-1].encode()).hexdigest(), x[2], x[3]))
            block.clear()

        size = 0
        for text in texts:
            if len(text) > SLICE:
                flush()
                found.append(self._sliced(text))
                size = 0
                continue
            block.append(text)
            size += len(text)
            if size > SLICE:
                flush()
                size = 0
        flush()
        return [x if t else None for x, t in zip(found, texts, strict=True)]

    def _sliced(self, text: str) -> tuple | None:
        digest, counts, pairs, times, held = hashlib.sha256(), np.zeros(4, dtype=np.int64), [], [], ""
        for part in slices(text):
            x = next(iter(list(self.aligned([part]))))
            if x is None:
                return None
            digest.update((held + x[1][:-1]).encode())
            held = ";"
            counts += x[0]
            pairs.append(x[2])
            times.append(x[3])
        return tuple(counts.tolist()), digest.hexdigest(), *summed(pairs, times)


def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and the sums of their times."""
    if not pairs:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)


def packed_times(times: np.ndarray) -> bytes:
    """A byte for each, or four if one needs them."""
    return times.astype("u1" if not len(times) or times.max() < 256 else "<u4").tobytes()


def opened_times(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="u1" if len(raw) == n else "<u4")


def opened_pairs(raw: bytes) -> np.ndarray:
    """Pairs that are kept as differences."""
    return np.cumsum(np.frombuffer(raw, dtype="<u4"), dtype=np.uint32)


_WORKER: dict[tuple, Aligner] = {}


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row of ALIGNED for each row of ``docs``; ``doc_no`` is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _WORKER:
            _WORKER[paths] = Aligner(*paths)
        no = TaskContext.get().partitionId() << 36
        none = (0, 0, 0, 0), "", np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for b in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()]
            rows = []
            for doc_id, x in zip(b.column("doc_id").to_pylist(), _WORKER[paths].documents(texts), strict=True):
                counts, digest, pairs, times = x or none
                rows.append((no, doc_id, *counts, digest, np.diff(pairs, prepend=np.uint32(0)).astype("<u4").tobytes(), packed_times(times)))
                no += 1
            kinds = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in ALIGNED.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, ALIGNED)


def counted(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): the documents that hold a pair, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found, n = summed(pairs, times)
            for k in range(0, len(found), 100_000):
                part = found[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((part >> 16).astype(np.int32)), pa.array((part & 0xFFFF).astype(np.int32)), pa.array(n[k : k + 100_000])], ["a", "b", "n"])

        for b in batches:
            for raw in b.column("pairs").to_pylist():
                pairs.append(opened_pairs(raw))
                times.append(np.ones(len(pairs[-1]), dtype=np.int64))
            if sum(map(len, pairs)) > FLUSH:
                found, n = summed(pairs, times)
                pairs, times = [found], [n]
                if len(found) > FLUSH // 2:
                    yield from out()
                    pairs, times = [], []
        yield from out()

    partial = map_arrow(rows.select("pairs"), run, "a int, b int, n long")
    pairs = partial.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def ranges(weights: list[tuple[int, int, int]], parts: int = RANGES, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """First A ids of ranges and their numbers of salts, from (a, pairs, postings) by A id."""
    weights = sorted(weights)
    share = max(1, -(-sum(w for _, _, w in weights) // parts))
    first, salts, pairs, postings = [0], [], 0, 0
    for a, p, w in weights:
        if postings and postings + w > share:
            salts.append(-(-postings // max(group, WORTH * pairs)))
            first.append(a)
            pairs = postings = 0
        pairs, postings = pairs + p, postings + w
    return np.array(first, dtype=np.int64), np.array([*salts, max(1, -(-postings // max(group, WORTH * pairs)))], dtype=np.int64)


def _rows_of(kind: int, rows: list[tuple[int, int, bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
    r, salt, docs, sizes, pairs, times = zip(*rows, strict=True)
    whole = [pa.array(r, pa.int32()), pa.array(salt, pa.int32()), pa.array([kind] * len(r), pa.int32())]
    return pa.RecordBatch.from_arrays(whole + [pa.array(x, pa.binary()) for x in (docs, sizes, pairs, times)], [c.split()[0] for c in PACKED.split(", ")])


def packed_counts(pairs: DataFrame, first: np.ndarray, salts: np.ndarray) -> DataFrame:
    """The counts of each range, for each of its salts: ``sizes`` are counts, ``times`` tell the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, other, n, best = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "best"))
            of = np.searchsorted(first, a, side="right") - 1
            for r in np.unique(of).tolist():
                mine = of == r
                packed = b"", n[mine].astype("<i8").tobytes(), (a[mine].astype(np.uint32) << 16 | other[mine].astype(np.uint32)).astype("<u4").tobytes(), best[mine].astype("u1").tobytes()
                for salt in range(salts[r]):
                    yield _rows_of(COUNTS, [(r, salt, *packed)])

    return map_arrow(pairs, run, PACKED)


def packed_postings(rows: DataFrame, first: np.ndarray, salts: np.ndarray) -> DataFrame:
    """The postings, by range and salt, of many documents in a row: ``docs``, how many of each (``sizes``), pairs and times."""
    bounds = (first[1:] << 16).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple[int, int], int] = {}

        def out(key: tuple[int, int]) -> tuple:
            docs, pairs, times = zip(*held.pop(key), strict=True)
            del sizes[key]
            return (*key, np.array(docs, dtype="<i8").tobytes(), np.array([len(x) for x in pairs], dtype="<u4").tobytes(), np.concatenate(pairs).astype("<u4").tobytes(), packed_times(np.concatenate(times)))

        total = 0
        for b in batches:
            for no, raw, times in zip(*(b.column(c).to_pylist() for c in ("doc_no", "pairs", "times")), strict=True):
                pairs = opened_pairs(raw)
                times = opened_times(times, len(pairs))
                total += len(pairs)
                cut = [0, *np.searchsorted(pairs, bounds).tolist(), len(pairs)]
                for r, (x, y) in enumerate(zip(cut, cut[1:])):
                    if x == y:
                        continue
                    key = r, no % int(salts[r])
                    held.setdefault(key, []).append((no, pairs[x:y], times[x:y]))
                    sizes[key] = sizes.get(key, 0) + y - x
                    if sizes[key] > ROW:
                        total -= sizes[key]
                        yield _rows_of(POSTINGS, [out(key)])
                if total > FLUSH:
                    yield _rows_of(POSTINGS, [out(k) for k in list(held)])
                    total = 0
        if held:
            yield _rows_of(POSTINGS, [out(k) for k in list(held)])

    return map_arrow(rows.select("doc_no", "pairs", "times"), run, PACKED)


def contributions(counts: DataFrame, postings: DataFrame, parts: int) -> DataFrame:
    """(doc_no, n_best, count_sum) that documents get from each range: counts and postings meet
    in sorted streams, a group's counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, said, table = None, [], None
        for b in batches:
            for r, salt, kind, docs, sizes, pairs, times in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                if (r, salt) != group:
                    group, said, table = (r, salt), [], None
                pairs = np.frombuffer(pairs, dtype="<u4")
                if kind == COUNTS:
                    said.append((pairs, np.frombuffer(sizes, dtype="<i8"), np.frombuffer(times, dtype="u1")))
                    continue
                if table is None:
                    known, n, best = (np.concatenate(x) for x in zip(*said, strict=True))
                    order, said = np.argsort(known), []
                    table = known[order], n[order], best[order]
                known, n, best = table
                at, times = np.searchsorted(known, pairs), opened_times(times, len(pairs)).astype(np.int64)
                starts = np.cumsum(s := np.frombuffer(sizes, dtype="<u4").astype(np.int64)) - s
                columns = np.frombuffer(docs, dtype="<i8"), np.add.reduceat(times * best[at], starts), np.add.reduceat(times * n[at], starts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_no", "n_best", "count_sum"])

    met = counts.union(postings).repartition(parts, "range", "salt").sortWithinPartitions("range", "salt", "kind")
    return map_arrow(met, run, "doc_no long, n_best long, count_sum long")


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, parts: int = RANGES, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256), and the table of pairs (a, b, n, best) of the corpus."""
    spark = docs.sparkSession
    rows = saved(aligned(docs, paths or default_paths()))
    pairs = saved(counted(rows))
    weights = pairs.groupBy("a").agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).collect()  # a row for each A id that occurs: a vocabulary at most
    first, salts = ranges([tuple(r) for r in weights], parts, group)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(salts.sum()) // 4)
    each = contributions(packed_counts(pairs, first, salts), packed_postings(rows, first, salts), tasks)
    sums = each.groupBy("doc_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    out = rows.select("doc_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "doc_no", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs


def op13_postings_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document, and how common its links are in the corpus."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
