"""Removal of repeated passages: seed and extend over winnowed anchors.

Words are hashed; every window of ``WINDOW`` words has as anchor the least hash of the
``GRAM``-word grams in it (winnowing), so equal windows have equal anchors, and
consecutive windows with one anchor form a run, the text around the anchor:

1. seeds: runs equal as a whole are one class; its smallest document keeps it, and in
   any larger document every window of the run is a repeat. Copies end here, combined
   before they shuffle, however many there are.
2. extension: where classes share an anchor, their smallest document's run is the hub.
   Every other class is laid on the hub at the anchor and extended word by word to the
   left and to the right, as far as both agree; a match of ``WINDOW`` words or more is
   a maximal repeat in the runs. One extension a class, so no pairs.
3. what reaches beyond the hub's match: two classes that share such a window leave the
   hub at the same word, to the left or to the right. So only classes that leave it
   equally, in two documents at least, are compared, by the hashes of the windows over
   that word. An anchor that stands several times in one run has no single place to
   extend from; all windows of its runs are compared so.
4. overlapping repeats of a document merge to maximal intervals, which are removed.

No pairs of documents are formed anywhere. Identity is 128 bits (anchor and run or
window), or the words themselves in the extension.

Defined results: a null text has no words; a document of under ``WINDOW`` words loses
nothing; a text is read whole however long (a task holds one batch of texts and the
word hashes of one); documents with equal ids are one document, so repeated rows keep
what only they share; of passages that tie, the smallest id's stays; rows with a null
id lose nothing and take nothing from others; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, map_arrow, saved

WINDOW, GRAM = 50, 16
_BASE = 0x9E3779B97F4A7C15 | 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    steps = np.full(n, base % (1 << 64), dtype=np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def rolling(hashes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A hash of every k consecutive words, equal for equal words wherever they stand."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    back = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(n, base), out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * _powers(n - k + 1, back))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window the least gram hash in it."""
    least, reach, want = rolling(hashes, gram), 1, window - gram + 1
    while reach < want:  # least[i] covers reach grams from i on
        step = min(reach, want - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def _runs(words: list[bytes], window: int, gram: int):
    """anchor, hash of the whole run, first window and number of windows, for each run."""
    if len(words) < window:
        return None
    h = word_hashes(words)
    a = anchors(h, window, gram)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    count = np.diff(np.append(first, len(a)))
    base = _BASE * 3 | 1
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(len(h), base), out=sums[1:])
    back = _powers(len(h), pow(base, -1, 1 << 64))
    run = _mixed((sums[first + count + window - 1] - sums[first]) * back[first] + count.astype(np.uint64))
    return a[first], run, first, count


def _run_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "run", "id", "mark", "first", "windows"]
        for b in batches:
            got: list[tuple] = []
            held = 0
            for text, i, mark in zip(b.column("text"), b.column("id").to_pylist(), b.column("mark").to_pylist(), strict=True):
                found = _runs((text.as_py() or b"").split(), window, gram)
                if found is not None:
                    got.append((*found, np.full(len(found[0]), i), np.full(len(found[0]), mark)))
                    held += len(found[0])
                if held > 200_000:
                    yield _as_batch(got, names)
                    got, held = [], 0
            if got:
                yield _as_batch(got, names)

    return run


def _as_batch(got: list[tuple], names: list[str]) -> pa.RecordBatch:
    a, r, f, n, i, m = (np.concatenate(x) for x in zip(*got, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(i.astype(np.int64)), pa.array(m.astype(np.int64)), pa.array(f.astype(np.int32)), pa.array(n.astype(np.int32))], names)


def _context_rows(window: int, gram: int):
    """The words of the given runs of a text, after the place of the anchor among them
    (``words``), and whether that is its only place (``alone``)."""
    names = ["anchor", "id", "mark", "lo", "first", "alone", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, i, mark, spans in zip(b.column("text"), b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.as_py().split()
                grams = rolling(word_hashes(words), gram).view(np.int64)
                for s in spans:
                    first, end = s["first"], s["first"] + s["windows"] + window - 1
                    places = np.flatnonzero(grams[first : end - gram + 1] == s["anchor"])
                    rows.append((s["anchor"], i, mark, s["lo"], first, len(places) == 1, b"%d %b" % (places[0], b" ".join(words[first:end]))))
                    if len(rows) >= 5_000:
                        yield _from_rows(rows, names, types)
                        rows = []
            if rows:
                yield _from_rows(rows, names, types)

    return run


def _from_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def agreeing(one: list[bytes], i: int, other: list[bytes], j: int, gram: int) -> tuple[int, int]:
    """How many words agree to the left and to the right of grams at ``i`` and ``j``."""
    left = right = 0
    for a, b in zip(reversed(one[:i]), reversed(other[:j]), strict=False):
        if a != b:
            break
        left += 1
    for a, b in zip(one[i + gram :], other[j + gram :], strict=False):
        if a != b:
            break
        right += 1
    return left, right


def _key(side: bytes, count: int, words: list[bytes]) -> int:
    v = xxhash.xxh64_intdigest(b"%b%d %b" % (side, count, b" ".join(words)))
    return v - (1 << 64) if v >> 63 else v


def _extended(window: int, gram: int):
    """Each run laid on its anchor's hub: the maximal repeat (no ``key``), and the parts
    that reach beyond the match, keyed by how they leave the hub."""
    names = ["anchor", "key", "id", "mark", "s", "e", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def parts(words: list[bytes], seed: int, hub: list[bytes], at: int):
        """(key or None, from, to) within the run."""
        if words[seed : seed + gram] != hub[at : at + gram]:  # another gram with this hash
            yield _key(b"g", 0, words[seed : seed + gram]), 0, len(words)
            return
        left, right = agreeing(words, seed, hub, at, gram)
        s, e = seed - left, seed + gram + right
        if e - s >= window:
            yield None, s, e
        if s > 0:
            yield _key(b"l", left, words[s - 1 : s]), 0, min(s + window - 1, len(words))
        if e < len(words):
            yield _key(b"r", right, words[e : e + 1]), max(0, e - window + 1), len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for a, i, mark, lo, first, single, text, hub in zip(*(b.column(c).to_pylist() for c in ["anchor", "id", "mark", "lo", "first", "single", "words", "hub"]), strict=True):
                seed, *words = text.split()
                if single:
                    at, *other = hub.split()
                    found = parts(words, int(seed), other, int(at))
                else:
                    found = [(0, 0, len(words))]
                for key, s, e in found:
                    if key is not None:
                        rows.append((a, key, i, mark, first + s, first + e, b" ".join(words[s:e])))
                    elif lo < i:
                        rows.append((a, None, i, mark, first + s, first + e, None))
            if rows:
                yield _from_rows(rows, names, types)

    return run


def _window_rows(window: int):
    """The hash of every window of the given parts of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for a, i, mark, s, text in zip(*(b.column(c).to_pylist() for c in ["anchor", "id", "mark", "s", "words"]), strict=True):
                h = rolling(word_hashes(text.split()), window, _BASE * 5 | 1)
                n = len(h)
                got.append((np.full(n, a), h, np.arange(s, s + n), np.full(n, i), np.full(n, mark)))
            if got:
                a, h, at, i, m = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h.view(np.int64)), pa.array(i), pa.array(m), pa.array(at.astype(np.int32))], ["anchor", "window", "id", "mark", "at"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, mark, spans): for each text with repeats, the word intervals [from, to) to remove, not yet merged.

    ``docs``: id long, mark long (a hash of the text), text binary.
    """
    known = docs.where("id is not null")
    runs = saved(map_arrow(known, _run_rows(window, gram), "anchor long, run long, id long, mark long, first int, windows int"))
    classes = saved(runs.groupBy("anchor", "run").agg(F.min("id").alias("least"), F.max("id").alias("most")))
    # aggregates are written before they meet a hot anchor: adaptive execution splits a join's side only straight after an exchange of its own
    several = saved(classes.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("anchor", "lo"))
    told = classes.join(several, "anchor", "left").where("least < most or lo is not null").select("anchor", "run", "least", "lo")
    shared = saved(runs.join(told, ["anchor", "run"]).where("least < id or lo is not null").select("anchor", "id", "mark", "first", "windows", "least", "lo"))
    for table in (runs, classes, several):
        dropped(table)
    whole = shared.where("least < id").select("id", "mark", F.col("first").alias("s"), (F.col("first") + F.col("windows") + F.lit(window - 1)).alias("e"))

    open_runs = shared.where("least = id and lo is not null").groupBy("id", "mark").agg(F.collect_set(F.struct("anchor", "lo", "first", "windows")).alias("spans"))
    again = known.join(open_runs, ["id", "mark"]).select("id", "mark", "text", "spans")
    contexts = saved(map_arrow(again, _context_rows(window, gram), "anchor long, id long, mark long, lo long, first int, alone boolean, words binary"))
    hubs = saved(contexts.groupBy("anchor").agg(F.bool_and("alone").alias("single"), F.min(F.when(F.col("id") == F.col("lo"), F.col("words"))).alias("hub")))
    laid = contexts.join(hubs, "anchor").select("anchor", "id", "mark", "lo", "first", "single", "words", "hub")
    found = saved(map_arrow(laid, _extended(window, gram), "anchor long, key long, id long, mark long, s int, e int, words binary"))
    dropped(contexts)
    dropped(hubs)
    matched = found.where("key is null").select("id", "mark", "s", "e")

    beyond = found.where("key is not null")
    alike = saved(beyond.groupBy("anchor", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor", "key"))
    rest = beyond.join(alike, ["anchor", "key"]).select("anchor", "id", "mark", "s", "words")
    windows = saved(map_arrow(rest, _window_rows(window), "anchor long, window long, id long, mark long, at int"))
    lowest = saved(windows.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("anchor", "window", "least"))
    single = windows.join(lowest, ["anchor", "window"]).where("least < id").select("id", "mark", F.col("at").alias("s"), (F.col("at") + F.lit(window)).alias("e"))
    out = saved(whole.union(matched).union(single).groupBy("id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    for table in (shared, found, alike, windows, lowest):
        dropped(table)
    return out


def _cut(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
        words = (text.as_py() or b"").split()
        if not spans:
            yield len(words), 0, b" ".join(words)
            continue
        edge = np.zeros(len(words) + 1, dtype=np.int32)
        np.add.at(edge, [x["s"] for x in spans], 1)
        np.add.at(edge, [x["e"] for x in spans], -1)
        stays = np.cumsum(edge[:-1]) == 0
        yield len(words), int(len(words) - stays.sum()), b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the remaining words, one space between, as UTF-8 binary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = zip(*_cut(b), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(repeats(rows, window, gram), ["id", "mark"], "left").select("id", "text", "spans")
    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Word counts and the SHA-256 of what stays, for every document."""
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM starts
), lowest AS (
  SELECT k, min(doc_id) AS least FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM windows JOIN lowest USING (k) WHERE least < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT e.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
         string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
