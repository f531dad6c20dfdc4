"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut into units (spaces and the word after them; spaces at the end are one) and
at two unit ends, which hashes of the document's id choose, into prefix, middle and
suffix. Ends and marker strings are the outputs of one automaton over UTF-8 bytes: in
spaces, in a word, or in a word behind ``<``, ``<P``, ``<S`` or ``<M``.

Chunks of ``CHUNK`` bytes are scanned apart from each other. A chunk does not know the
state that it is entered in, so it emits its transition function (the exit state for each
entry state) and, for each entry state, the ends and markers in it. Functions compose
associatively: chunks to blocks of ``BLOCK`` chunks, blocks to documents. From the
document's totals the hashes choose the ends to cut at; the block and then the chunk that
hold such an end are found by running counts, and only those chunks are scanned again.

A document of one chunk is entered in the start state, so it is scanned and rendered where
it lies. Longer ones are dealt out by chunk; of them only a few numbers a chunk are kept,
and the text moves once more, to meet its cuts.

Defined results: a null or empty text has no units and is plain; a null id hashes as an
empty number; a text of any length (up to the 2 GB of a value) is cut whole; repeated rows
are rendered one by one, all alike; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import map_arrow, saved

CHUNK, BLOCK = 1 << 16, 256
PERCENT, SPM_PERCENT, SEED = 50, 80, 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: States of the automaton; a document starts in SPACE, and all but SPACE are in a word.
SPACE, WORD, LESS, LESS_P, LESS_S, LESS_M = STATES = range(6)
#: Bytes that any two entry states need at most to meet: the longest proper part of a marker.
MEET = 2

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix string, middle string, suffix string, output string, output_sha256 string, restored_sha256 string"
DIGESTS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_INNER = np.zeros(256, dtype=bool)
_INNER[0x80:0xC0] = True


def step(state: int, byte: int) -> tuple[int, int, int]:
    """(next state, 1 if a word ended before this byte, 1 if a marker ended with it)."""
    if _SPACE[byte]:
        return SPACE, int(state != SPACE), 0
    if byte == ord("<"):
        return LESS, 0, 0
    if state == LESS and byte in b"PSM":
        return LESS_P + b"PSM".index(byte), 0, 0
    return WORD, 0, int(state >= LESS_P and byte == ord(">"))


def ends(chunk: np.ndarray, entry: int) -> np.ndarray:
    """Offsets at which words end: spaces that a word's byte (or state) stands before."""
    space = _SPACE[chunk]
    before = np.empty_like(space)
    before[:1], before[1:] = entry == SPACE, space[:-1]
    return np.flatnonzero(space & ~before)


def characters(chunk: np.ndarray) -> int:
    return len(chunk) - int(np.count_nonzero(_INNER[chunk]))


def scanned(chunk: bytes) -> tuple[list[int], list[int], list[int]]:
    """Exit states, word ends and markers of a chunk that is not empty, by entry state."""
    data = np.frombuffer(chunk, dtype=np.uint8)
    n_ends, n_marks = len(ends(data, SPACE)), sum(map(chunk.count, (PREFIX, SUFFIX, MIDDLE)))
    state = SPACE
    for byte in chunk[-MEET - 1 :]:  # from SPACE or a wrong state: MEET bytes on they have met
        state = step(state, byte)[0]
    exits, all_ends, all_marks = [], [], []
    head = chunk[:MEET]
    for entry in STATES:
        # counts from SPACE, and what the first bytes add from another state
        at, mine, there = entry, [0, 0], [0, 0]
        other = SPACE
        for byte in head:
            at, e, m = step(at, byte)
            mine = [mine[0] + e, mine[1] + m]
            other, e, m = step(other, byte)
            there = [there[0] + e, there[1] + m]
        exits.append(state if len(chunk) > MEET else at)
        all_ends.append(n_ends + mine[0] - there[0])
        all_marks.append(n_marks + mine[1] - there[1])
    return exits, all_ends, all_marks


def plan(doc_id: int | None, n: int, marked: bool, percent: int, spm_percent: int, seed: int) -> tuple[str, int, int]:
    """(form, units before the middle, units before the suffix) by the hashes of the id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    form = "plain" if n == 0 or marked or h3 % 100 >= percent else "spm" if h4 % 100 < spm_percent else "psm"
    first, second = h1 % (n + 1), h2 % (n + 1)
    return form, min(first, second), max(first, second)


def rendered(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restored(form: str, output: bytes) -> bytes:
    """The text, from the output and its form alone; texts with markers are plain, so the first of each is ours."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX, 3)
    third = output.index(MIDDLE, second + 3)
    first, last, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return first + middle + last if form == "psm" else last + middle + first


def _row(doc_id, text: bytes, n: int, form: str, cuts: tuple[int, int], chars: tuple[int, int], whole: bool) -> tuple:
    """A row of RESULT; the texts stay out unless ``whole``."""
    if form == "plain":
        digest = hashlib.sha256(text).hexdigest()
        return (doc_id, n, form, None, None, None, None, None, text if whole else None, digest, digest)
    parts = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    output = rendered(form, *parts)
    back = restored(form, output)
    shown = (*parts, output) if whole else (None,) * 4
    return (doc_id, n, form, *chars, *shown, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6]
    names = [c.split()[0] for c in RESULT.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x.decode() if isinstance(x, bytes) else x for x in c], t) for c, t in zip(columns, kinds, strict=True)], names)


def _text_bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _short(docs: DataFrame, choice: tuple[int, int, int], whole: bool) -> DataFrame:
    """Documents of one chunk, scanned from the start state and rendered in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                at = ends(data, SPACE)
                n = len(at) + (len(text) > 0)
                form, low, high = plan(doc_id, n, any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), *choice)
                low, high = (0 if k == 0 else len(text) if k == n else int(at[k - 1]) for k in (low, high))
                chars = (0, 0) if form == "plain" else (characters(data[:low]), characters(data[low:high]))
                out.append(_row(doc_id, text, n, form, (low, high), chars, whole))
            if out:
                yield _batch(out)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_bytes().alias("text")), run, RESULT)


SUMMARY = "exits array<int>, ends array<long>, marks array<long>"
KEY = ["doc_id", "hash", "bytes"]


def summaries(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(*KEY, no, exits, ends, marks, chars) for every chunk of the texts of ``keyed``, dealt out by chunk."""
    count = F.ceil(F.col("bytes") / F.lit(chunk)).cast("int")
    parts = keyed.select(*KEY, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("no"))
    parts = parts.select(*KEY, "no", F.substring("text", F.col("no") * chunk + 1, F.lit(chunk)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(*scanned(p), characters(np.frombuffer(p, dtype=np.uint8))) for p in b.column("part").to_pylist()]
            if found:
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*KEY, "no"]), *columns], [*KEY, "no", "exits", "ends", "marks", "chars"])

    return map_arrow(parts.repartition(*KEY, "no"), run, f"doc_id long, hash long, bytes long, no int, {SUMMARY}, chars long")


def composed(parts: Column) -> Column:
    """The composition, in order, of an array of (no, exits, ends, marks, chars)."""
    zero = F.array([F.lit(0).cast("long")] * len(STATES))
    start = F.struct(F.array([F.lit(s) for s in STATES]).alias("exits"), zero.alias("ends"), zero.alias("marks"), F.lit(0).cast("long").alias("chars"))

    def then(a: Column, b: Column) -> Column:
        carried = lambda name: F.zip_with(a[name], a["exits"], lambda count, state: count + F.get(b[name], state))
        return F.struct(
            F.transform(a["exits"], lambda state: F.get(b["exits"], state)).alias("exits"),
            carried("ends").alias("ends"),
            carried("marks").alias("marks"),
            (a["chars"] + b["chars"]).alias("chars"),
        )

    return F.aggregate(F.sort_array(parts), start, then)


def _compose(df: DataFrame, by: list[str], no: str) -> DataFrame:
    """One summary a group; equal rows (of repeated documents) count once."""
    parts = F.collect_set(F.struct(F.col(no), "exits", "ends", "marks", "chars"))
    return df.groupBy(*by).agg(composed(parts).alias("all")).select(*by, "all.*")


def _with(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins by columns that may be null; ``right`` leaves its own out."""
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in by], how).drop(*[f"r_{c}" for c in by])


def _entered(cuts: DataFrame, parts: DataFrame, by: list[str], no: str) -> DataFrame:
    """Each cut of ``cuts`` (*by, cut, rank, entry, before) with the part of ``parts`` that holds
    its end: the rank within the part, its entry state and the characters before it."""
    fields = F.sort_array(F.collect_set(F.struct(F.col(no).alias("no"), "exits", "ends", "chars"))).alias("parts")
    joined = _with(cuts, parts.groupBy(*by).agg(fields), by)
    start = F.struct(
        F.lit(-1).alias("no"), F.col("entry").alias("state"), F.col("entry").alias("held_entry"), F.col("rank").alias("rank"), F.col("before").alias("before"), F.lit(False).alias("found")
    )

    def go(acc: Column, part: Column) -> Column:
        here = F.get(part["ends"], acc["state"])
        found = acc["found"] | (acc["rank"] <= here)
        onward = lambda old, new: F.when(found, old).otherwise(new)
        return F.struct(
            F.when(acc["found"], acc["no"]).otherwise(part["no"]).alias("no"),
            onward(acc["state"], F.get(part["exits"], acc["state"])).alias("state"),
            F.when(acc["found"], acc["held_entry"]).otherwise(acc["state"]).alias("held_entry"),
            onward(acc["rank"], acc["rank"] - here).alias("rank"),
            onward(acc["before"], acc["before"] + part["chars"]).alias("before"),
            found.alias("found"),
        )

    out = joined.withColumn("at", F.aggregate("parts", start, go))
    return out.select(*by, "cut", F.col("at.no").alias(no), F.col("at.rank").alias("rank"), F.col("at.held_entry").alias("entry"), F.col("at.before").alias("before"))


def _hashed(choice: tuple[int, int, int], n: Column, marked: Column) -> list[Column]:
    """``plan`` as columns."""
    percent, spm_percent, seed = choice
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25))
    form = F.when((n == 0) | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return [form.alias("form"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("low"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("high")]


def _long(docs: DataFrame, choice: tuple[int, int, int], whole: bool, chunk: int, block: int) -> DataFrame:
    """Documents of many chunks: summaries, composition, selection, and the texts at their cuts."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), _text_bytes().alias("text"))
    keyed = keyed.select("doc_id", "hash", F.octet_length("text").cast("long").alias("bytes"), "text")
    chunks = saved(summaries(keyed, chunk).withColumn("block", F.expr(f"cast(no div {block} as int)")))
    blocks = saved(_compose(chunks, [*KEY, "block"], "no"))
    n = F.get("ends", F.lit(SPACE)) + 1
    totals = _compose(blocks, KEY, "block").select(*KEY, n.alias("n"), (F.get("marks", F.lit(SPACE)) > 0).alias("marked"), "chars")
    totals = saved(totals.select("*", *_hashed(choice, F.col("n"), F.col("marked"))))
    # ends 1 to n - 1 are word ends within the text; 0 and n are its own ends
    wanted = totals.where("form <> 'plain'").select(*KEY, "n", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("low").alias("rank")), F.struct(F.lit(1).alias("cut"), F.col("high").alias("rank")))).alias("w"))
    wanted = wanted.where("w.rank > 0 and w.rank < n").select(*KEY, "w.cut", "w.rank", F.lit(SPACE).alias("entry"), F.lit(0).cast("long").alias("before"))
    in_block = _entered(wanted, blocks, KEY, "block")
    in_chunk = _entered(in_block, chunks, [*KEY, "block"], "no")
    places = in_chunk.groupBy(*KEY).agg(F.collect_list(F.struct("cut", "no", "rank", "entry", "before")).alias("places"))
    # written, so that adaptive execution can split the rows of many copies of one document
    plans = saved(_with(totals, places, KEY, "left").select(*KEY, "n", "form", "low", "high", "chars", "places"))
    told = _with(keyed, plans, KEY).select("doc_id", "text", "n", "form", "low", "high", "chars", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                text, n = row["text"], row["n"]
                at = {p["cut"]: _found(text, p, chunk) for p in row["places"] or ()}
                bounds = [(0, 0) if k == 0 else (len(text), row["chars"]) if k == n else at.get(cut, (0, 0)) for cut, k in enumerate((row["low"], row["high"]))]
                (low, before), (high, upto) = bounds
                yield _batch([_row(row["doc_id"], text, n, row["form"], (low, high), (before, upto - before), whole)])

    return map_arrow(told, run, RESULT)


def _found(text: bytes, place: dict, chunk: int) -> tuple[int, int]:
    """(bytes, characters) before an end, of which the chunk, the entry state and the rank in the chunk are known."""
    begun = place["no"] * chunk
    data = np.frombuffer(text[begun : begun + chunk], dtype=np.uint8)
    at = int(ends(data, place["entry"])[place["rank"] - 1])
    return begun + at, place["before"] + characters(data[:at])


def infilled(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, whole: bool = True, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """A row of RESULT for each document; without ``whole``, the texts in it are null."""
    choice = (percent, spm_percent, seed)
    rows, longer = docs.select("doc_id", "text"), F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    return _short(rows.where(~longer), choice, whole).union(_long(rows.where(longer), choice, whole, chunk, block))


def op11_automaton_infilling(spark, sf_dir: str) -> DataFrame:
    """Units, form, characters of the parts, and digests of the output and of the text rebuilt from it."""
    return infilled(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=False).select(*DIGESTS)


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), told AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut
), formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                 WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high
  FROM told
), parts AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
