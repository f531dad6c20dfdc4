"""Secret scans that link the parts of credentials.

A credential has up to three parts: an identifier, a secret and an endpoint. Some parts
tell themselves (an assignment to ``password``, an access key id, a long hexadecimal run)
and are reported wherever they stand. Others are weak: an account name, a mixed run that
may be a key or any other token, the address of a host. A weak candidate is reported only
if complementary parts stand in its scope, the ``SCOPE`` code points on both of its sides:
an identifier needs a secret, a secret an identifier, an endpoint both.

Texts are searched where they lie; only spans are kept. Spans and scopes then meet in an
interval join within cells of ``CELL`` code points of a document: a scope reaches into a
few cells, and in a cell, ordered by place, the farthest end of the parts of each role
that begin before a scope ends tells whether one reaches into it. So nothing pairs
candidates with each other, and neither a long text nor a common passage is one task's.

Defined results: a null or empty text has no spans; a null id is kept; rows are searched
one by one, repeated or not; kinds are searched independently, so that spans of different
kinds may overlap, but no weak secret or identifier overlaps a part that tells itself;
letters of names are compared in ASCII; a text of any length is searched whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import map_arrow, saved

SCOPE, CELL = 400, 8192

KINDS = ASSIGN, ACCESS, HEX, SECRET, IDENT, ENDPOINT = range(6)
NAMES = ("assign", "access", "hex", "secret", "ident", "endpoint")
ROLE = {ACCESS: "identifier", IDENT: "identifier", ASSIGN: "secret", HEX: "secret", SECRET: "secret", ENDPOINT: "endpoint"}
#: Roles that must stand in the scope of a weak candidate.
NEEDS = {SECRET: ("identifier",), IDENT: ("secret",), ENDPOINT: ("identifier", "secret")}

ASSIGNED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS_ID, HEXADECIMAL, MIXED = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
NAMED = re.compile(r"""(?:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
ADDRESS = re.compile(r"https?://[A-Za-z0-9._:/-]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}")
PORT = re.compile(":[0-9]{2}")

FOUND = "doc_no long, doc_id long, base array<struct<start:long,kind:int,end:long>>, weak array<struct<start:long,kind:int,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def told(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the parts that tell themselves."""
    out, lower = [], text.lower()
    if any(k in lower for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), ASSIGN, m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in ACCESS_ID.finditer(text) if len(m[0]) >= 20]
    if any(len(w) >= 24 for w in text.split()):
        out += [(m.start(), HEX, m.end()) for m in HEXADECIMAL.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak candidates."""
    out, lower = [], text.lower()
    if any(len(w) >= 20 for w in text.split()):
        runs = [m for m in MIXED.finditer(text) if any("a" <= c <= "z" for c in m[0]) and any("A" <= c <= "Z" for c in m[0]) and any("0" <= c <= "9" for c in m[0])]
        out += [(m.start(), SECRET, m.end()) for m in runs]
    if any(k in lower for k in ("access", "client", "account", "user", "login")):
        out += [(m.start(), IDENT, m.end()) for m in NAMED.finditer(text)]
    free, at, reach = [], 0, 0
    for start, kind, end in sorted(out):
        while at < len(base) and base[at][0] < end:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= start:
            free.append((start, kind, end))
    if "://" in text or PORT.search(text):
        free += [(m.start(), ENDPOINT, m.end()) for m in ADDRESS.finditer(text)]
    return sorted(free)


def searched(docs: DataFrame) -> DataFrame:
    """A row of FOUND for each row; ``doc_no`` is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = (text or b"").decode("utf-8", "replace")
                base = told(text)
                rows.append((no, base, candidates(text, base)))
                no += 1
            if rows:
                numbers, base, weak = zip(*rows, strict=True)
                spans = [pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in c], _SPANS) for c in (base, weak)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column("doc_id"), *spans], ["doc_no", "doc_id", "base", "weak"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, FOUND)


def _cells(low: Column, high: Column, cell: int) -> Column:
    """The cells that the half-open interval touches."""
    at = lambda x: F.floor(x / F.lit(cell))
    return F.explode(F.sequence(at(low), at(high - 1)))


def linked(found: DataFrame, scope: int = SCOPE, cell: int = CELL) -> DataFrame:
    """(doc_no, start, kind, end) of the weak candidates that have their complementary parts in scope."""
    role = F.element_at(F.create_map(*[F.lit(x) for k, r in ROLE.items() for x in (k, r)]), F.col("kind"))
    some = found.where(F.size("weak") > 0)
    parts = some.select("doc_no", F.explode(F.concat("base", "weak")).alias("s")).select("doc_no", "s.*").withColumn("role", role)
    weak = some.select("doc_no", F.explode("weak").alias("s")).select("doc_no", "s.*")
    none = F.lit(None)
    held = parts.select("doc_no", _cells(F.col("start"), F.col("end"), cell).alias("cell"), F.col("start").alias("place"), F.lit(1).alias("part"), "role", F.col("end").alias("reach"), none.cast("long").alias("start"), none.cast("int").alias("kind"), none.cast("long").alias("end"))
    low, high = F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope
    asked = weak.select("doc_no", _cells(low, high, cell).alias("cell"), high.alias("place"), F.lit(0).alias("part"), none.cast("string").alias("role"), none.cast("long").alias("reach"), "start", "kind", "end")
    # a scope that ends where a part begins does not hold it: at one place, scopes come first
    before = Window.partitionBy("doc_no", "cell").orderBy("place", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    roles = sorted(set(ROLE.values()))
    near = held.union(asked).withColumns({r: F.max(F.when(F.col("role") == r, F.col("reach"))).over(before) > F.col("start") - scope for r in roles})
    near = near.where("part = 0").groupBy("doc_no", "start", "kind", "end").agg(*[F.coalesce(F.max(r), F.lit(False)).alias(r) for r in roles])
    wanted = F.lit(False)
    for kind, needs in NEEDS.items():
        holds = F.col("kind") == kind
        for r in needs:
            holds &= F.col(r)
        wanted |= holds
    return near.where(wanted).select("doc_no", "start", "kind", "end")


def _text(spans: Column) -> Column:
    names = F.array([F.lit(n) for n in NAMES])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE, cell: int = CELL) -> DataFrame:
    """(doc_id, base, links): for each row the spans that tell themselves and the weak ones
    that are linked, as arrays of (start, kind, end) with ``kind`` a place in NAMES."""
    found = saved(searched(docs))
    links = linked(found, scope, cell).groupBy("doc_no").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("links"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return found.join(links, "doc_no", "left").select("doc_id", "base", F.coalesce("links", none).alias("links"))


def op12_credential_linking(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count(ASSIGN).alias("n_assign"),
        count(ACCESS).alias("n_access"),
        count(HEX).alias("n_hex"),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.concat("base", "links")).alias("spans"),
    )


def _sql_kind(kind: int, pattern: str, least: str) -> str:
    """Spans of one kind: matches and what stands between them, in turn."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT no, {kind} AS kind, list_sum([length(x) FOR x IN gaps[1:k]])::BIGINT + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0)::BIGINT AS start, hits[k] AS hit
  FROM (SELECT no, unnest(range(1, len(hits) + 1)) AS k, hits, gaps FROM
        (SELECT no, regexp_extract_all(text, '{quoted}') AS hits, string_split_regex(text, '{quoted}') AS gaps FROM docs))
  WHERE {least}"""


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_IDENT = _either_case("(access_?key_?id|client_?id|account|username|user|login)") + """["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9@._-]{3,}"""
_LONG = f"length(regexp_extract(hits[k], '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6"
_MIXED = "regexp_matches(hits[k], '[a-z]') AND regexp_matches(hits[k], '[A-Z]') AND regexp_matches(hits[k], '[0-9]')"

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT no, kind, start, start + length(hit) AS finish FROM ({_sql_kind(ASSIGN, _ASSIGN, _LONG)}
  UNION ALL {_sql_kind(ACCESS, "AKIA[A-Z0-9]+", "length(hits[k]) >= 20")}
  UNION ALL {_sql_kind(HEX, "[0-9a-f]{24,}", "true")})
), loose AS (
  SELECT no, kind, start, start + length(hit) AS finish FROM ({_sql_kind(SECRET, "[A-Za-z0-9+/_-]{20,}={0,2}", _MIXED)}
  UNION ALL {_sql_kind(IDENT, _IDENT, "true")})
), weak AS (
  SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.no = l.no AND b.start < l.finish AND b.finish > l.start)
  UNION ALL SELECT no, kind, start, start + length(hit) FROM ({_sql_kind(ENDPOINT, ADDRESS.pattern, "true")})
), parts AS (
  SELECT *, CASE WHEN kind IN ({ACCESS}, {IDENT}) THEN 'i' WHEN kind = {ENDPOINT} THEN 'e' ELSE 's' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)
), near AS (
  SELECT w.*, EXISTS (SELECT 1 FROM parts p WHERE p.no = w.no AND p.role = 'i' AND p.start < w.finish + {SCOPE} AND p.finish > w.start - {SCOPE}) AS i,
         EXISTS (SELECT 1 FROM parts p WHERE p.no = w.no AND p.role = 's' AND p.start < w.finish + {SCOPE} AND p.finish > w.start - {SCOPE}) AS s
  FROM weak w
), spans AS (
  SELECT *, true AS told FROM base
  UNION ALL SELECT no, kind, start, finish, false FROM near WHERE (kind = {SECRET} AND i) OR (kind = {IDENT} AND s) OR (kind = {ENDPOINT} AND i AND s)
), said AS (
  SELECT *, (['assign', 'access', 'hex', 'secret', 'ident', 'endpoint'])[kind + 1] || ':' || start || ':' || finish AS span FROM spans
)
SELECT d.doc_id, count(*) FILTER (WHERE told AND kind = {ASSIGN}) AS n_assign, count(*) FILTER (WHERE told AND kind = {ACCESS}) AS n_access,
       count(*) FILTER (WHERE told AND kind = {HEX}) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, finish) FILTER (WHERE told), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind, finish), '') AS spans
FROM docs d LEFT JOIN said s ON s.no = d.no GROUP BY d.no, d.doc_id
"""
