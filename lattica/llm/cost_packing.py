"""Packing of token sequences by balanced cost.

Each document is tokenised where it lies and cut there: into whole sequences, then, from
what is left, a half and a quarter of a sequence if it has them, so that no piece that
has to find room is over a quarter but those. The pieces' lengths and digests move, and
the ids of short pieces, which may be cut once more to fill a sequence to the end.
Pieces are hashed to bins of a bounded number of tokens, repeated rows each on its own; in a bin, pieces by descending
length go to the open sequence of least cost (linear plus quadratic in each piece's
length, as attention within documents costs) that has room for them. Sequences without
room for the present length wait by their room and come back when lengths have fallen to
it, so a bin takes n log n steps.

Tokenising keeps, in each Python worker, the ids of the words that it has met; the ids of
new words of a text are got from the tokenizer together. The words are what ASCII spaces
separate, across which this tokenizer neither normalises nor merges.

Defined results: a null or empty text is the end id alone; a text of any length is cut to
pieces of at most a sequence; rows are packed one by one, repeated or not, with or without
id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow, map_groups, saved

CAPACITY, END = 4096, 2
#: Tokens in a bin, about, and words that a worker remembers.
BIN_TOKENS, WORDS = 4_000_000, 500_000
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 4096
#: Pieces of under 1 / SHORT of a sequence may be cut once more.
SHORT = 16

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "copy"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, word by word.

    Words are what the ASCII spaces separate, with A-Z lower-cased (as the tokenizer does
    itself). A word of Latin letters is one unit of the tokenizer, which ends with an
    end-of-word token, and the ASCII signs after it (but apostrophes) are another. New
    words of a text are encoded in one call by the tokenizer's bare model, which needs no
    normaliser or pattern for letters, and told apart by those tokens. All other words,
    and texts that may hold special tokens, are encoded by the tokenizer as they are.
    """

    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\x9e\xa0-\xb6\xb8-\xbf])+")
    SPECIAL, SIGNS = b"<|", b".,!?;:#$%&*|()[]{}/\\+-=_~^@<>\"`"

    def __init__(self, path: str, limit: int = WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: bytes) -> bytes:
        if self.SPECIAL in text:
            return self._encoded([text])[0].tobytes()
        words = text.lower().split()
        new = set(words).difference(self.known)
        if new:
            new = self._learned(new)
            self.known.update(new)
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > self.limit:
            for w in new:
                del self.known[w]
        return out

    def _learned(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The words and what they are composed of."""
        known, match, signs = self.known, self.LETTERS.fullmatch, self.SIGNS
        found, letters, others, composed = {}, set(), set(), []
        for w in words:
            stem = w.rstrip(signs)
            if not match(stem):
                others.add(w)
            elif len(stem) == len(w):
                letters.add(w)
            else:
                rest = w[len(stem) :]
                composed.append((w, stem, rest))
                if stem not in known:
                    letters.add(stem)
                if rest not in known:
                    others.add(rest)
        if letters:
            letters = list(letters)
            done = self.bare.encode_batch_fast([b" ".join(letters).decode().lower()], add_special_tokens=False)
            ids = np.array(done[0].ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), 0
                for w, end in zip(letters, ends, strict=True):
                    found[w] = raw[at:end]
                    at = end
            else:
                others.update(letters)
        for w, x in zip(others, self._encoded(list(others)), strict=True):
            found[w] = x.tobytes()
        for w, stem, rest in composed:
            found[w] = (found.get(stem) or known[stem]) + (found.get(rest) or known[rest])
        return found

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in done]


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    for part in (capacity // 2, capacity // 4):
        if part and left >= part:
            out.append(part)
            left -= part
    return out + [left] * (left > 0)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids, copy): every id of every document
    in one piece; ``ids`` is null for pieces that are not short, unless ``keep_ids``; ``copy``
    is zero but for repeated rows, which it tells apart so that they spread over the bins."""
    last, short = np.array([end], dtype="<u4").tobytes(), capacity // SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_ids(path), TaskContext.get().partitionId()
        for no, b in enumerate(batches):
            got, seen = [], Counter()
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = words.ids(text.as_py() or b"") + last
                at, n = 0, len(ids) // 4
                own = (doc, n)  # rows of one id and length count as repeated
                copy = seen[own] and hash((task, no, seen[own])) >> 1
                seen[own] += 1
                for size in cuts(n, capacity):
                    part = ids[at * 4 : (at + size) * 4]
                    got.append((doc, at, size, zlib.crc32(part), n, part if keep_ids or size < short else None, copy))
                    at += size
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            for k in range(0, len(got), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[k : k + 20_000], strict=True), kinds, strict=True)], NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, SCHEMA + ", ids binary, copy long")


def packed(lengths: list[int], capacity: int = CAPACITY, quadratic: int = QUADRATIC, short: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for lengths in descending order;
    items of under ``short`` may be cut where no sequence has room for them whole."""
    count = -(-sum(lengths) // capacity)
    open_now = [(0, s) for s in range(count)]  # a heap by cost
    room, waiting = [capacity] * count, defaultdict(list)  # waiting: by room
    rooms: list[int] = []  # a heap of negated rooms that have waiting sequences
    for item, whole in enumerate(lengths):
        start = 0
        while start < whole:
            n = whole - start
            while rooms and -rooms[0] >= n:
                for entry in waiting.pop(-heapq.heappop(rooms)):
                    heapq.heappush(open_now, entry)
            while open_now and room[open_now[0][1]] < n:
                cost, s = heapq.heappop(open_now)
                if room[s]:
                    if room[s] not in waiting:
                        heapq.heappush(rooms, -room[s])
                    waiting[room[s]].append((cost, s))
            if open_now:
                cost, s = heapq.heappop(open_now)
            elif rooms and whole < short:
                cost, s = waiting[-rooms[0]].pop()
                n = room[s]
                if not waiting[n]:
                    del waiting[n]
                    heapq.heappop(rooms)
            else:
                cost, s = 0, len(room)
                room.append(capacity)
            yield item, start, n, s, capacity - room[s]
            room[s] -= n
            start += n
            heapq.heappush(open_now, (cost + n * quadratic + n * n, s))


def pack(cut: DataFrame, capacity: int = CAPACITY, bin_tokens: int = BIN_TOKENS, keep_ids: bool = False) -> DataFrame:
    """``cut`` (as from ``pieces``, written) with ``sequence_id`` and ``offset``."""
    total = cut.agg(F.sum("length")).first()[0] or 0
    bins = max(1, round(total / bin_tokens))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        item, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*packed(t["length"].to_pylist(), capacity, short=capacity // SHORT), strict=True))
        first, parted = t["bin"][0].as_py() << 32, length != t["length"].to_numpy()[item]
        t = t.take(pa.array(item))
        crc, ids = t["ids_crc32"].to_numpy().copy(), t["ids"].to_pylist()
        for k in np.flatnonzero(parted):
            ids[k] = ids[k][start[k] * 4 : (start[k] + length[k]) * 4]
            crc[k] = zlib.crc32(ids[k])
        columns = [t["doc_id"], pa.array(t["start"].to_numpy() + start), pa.array(length), pa.array(crc), t["doc_tokens"], pa.array(first + sequence), pa.array(offset)]
        return pa.table(columns + [pa.array(ids, pa.binary())] * keep_ids, names=NAMES[:5] + ["sequence_id", "offset"] + ["ids"] * keep_ids)

    dealt = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(bins)))
    schema = SCHEMA + ", sequence_id long, offset long" + ", ids binary" * keep_ids
    return map_groups(dealt, ["bin"], run, schema)


def packed_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequences; with ``keep_ids`` also their ids (little-endian, 32 bits)."""
    return pack(saved(pieces(docs, path or default_tokenizer(), keep_ids=keep_ids)), keep_ids=keep_ids)


def op4_cost_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the sequences."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
