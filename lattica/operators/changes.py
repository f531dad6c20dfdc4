"""Change sets: inserts, updates and deletes as new DataFrames, and set operations.

Without a table format there is nothing to update in place; each function returns what
the table would hold, for a caller that writes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.written import written


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def changed_rows(df: DataFrame, where: Column) -> DataFrame:
    """One row, ``changed``: how many rows an update with this condition meets."""
    return df.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("changed"))


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Columns with new values where the condition holds (null counts as not)."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def merged(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edited columns over old ones, by key; a null in an edit keeps the old value."""
    names = [c for c in edits.columns if c not in key]
    new = edits.select(*key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = df.join(new, list(key), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def deep_merge(old: Column, new: Column, old_type: T.DataType, new_type: T.DataType) -> Column:
    """``new`` over ``old``: structs by field (fields of either), arrays by place, maps by key, to
    any depth; everything else is the new value, or the old one where that is null. A value
    whose kind changes (a struct for a number) cannot be typed and is refused."""
    if isinstance(old_type, T.StructType) and isinstance(new_type, T.StructType):
        a, b = {f.name: f.dataType for f in old_type}, {f.name: f.dataType for f in new_type}
        fields = []
        for name in [*a, *(n for n in b if n not in a)]:
            part = old[name] if name not in b else new[name] if name not in a else deep_merge(old[name], new[name], a[name], b[name])
            fields.append(part.alias(name))
        return F.when(old.isNull() & new.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    neither = old.isNull() & new.isNull()
    if isinstance(old_type, T.ArrayType) and isinstance(new_type, T.ArrayType):
        length = F.greatest(*[F.when(x.isNull(), 0).otherwise(F.size(x)) for x in (old, new)])
        merged_at = lambda i: deep_merge(F.get(old, i), F.get(new, i), old_type.elementType, new_type.elementType)
        return F.when(~neither, F.slice(F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), merged_at), F.lit(1), length))
    if isinstance(old_type, T.MapType) and isinstance(new_type, T.MapType):
        held = lambda x, t: F.coalesce(x, F.map_from_arrays(F.array().cast(T.ArrayType(t.keyType)), F.array().cast(T.ArrayType(t.valueType))))
        return F.when(~neither, F.map_zip_with(held(old, old_type), held(new, new_type), lambda _, a, b: deep_merge(a, b, old_type.valueType, new_type.valueType)))
    if any(isinstance(t, (T.StructType, T.ArrayType, T.MapType)) for t in (old_type, new_type)) and not isinstance(new_type, T.NullType):
        raise TypeError(f"{new_type.simpleString()} cannot be merged over {old_type.simpleString()}")
    return F.coalesce(new, old)


def deep_merged(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``merged``, nested columns included (see ``deep_merge``); columns that only the edits have are added."""
    names = [c for c in edits.columns if c not in key]
    new = edits.select(*key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = df.join(new, list(key), "left")
    old_types, new_types = ({f.name: f.dataType for f in x.schema} for x in (df, edits))
    one = lambda c: deep_merge(F.col(c), F.col(f"_new_{c}"), old_types[c], new_types[c]).alias(c) if c in names else F.col(c)
    return out.select(*[one(c) for c in df.columns], *[F.col(f"_new_{c}").alias(c) for c in names if c not in df.columns])


def deleted(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``keys``."""
    return df.join(keys, list(on), "left_anti")


def cascade(tables: dict[str, DataFrame], links: Sequence[tuple[str, Sequence[str], str, Sequence[str]]], root: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes rows of ``root`` and, table by table, all rows that refer to a row that goes.

    ``links``: foreign keys (child, its columns, parent, the parent's columns); ``doomed``:
    the keys of the root's rows, by columns of the root. Returns what stays of each table and
    (table, deleted), a row for each table. A null reference refers to nothing.

    The closure goes parents first, with one join for each foreign key. Tables that refer to
    each other in a ring (or to themselves, as trees do) are joined anew until a round finds
    nothing more; a round takes only the rows that the one before has found.
    """
    groups, rings = _parents_first([t for t in tables], links, root)
    gone: dict[str, DataFrame] = {}
    stays = dict(tables)

    def references(t: str, parents: dict[str, DataFrame]) -> list[tuple[Sequence[str], DataFrame]]:
        return [(own, parents[p].select(*keys)) for c, own, p, keys in links if c == t and p in parents]

    for group in groups:
        outer = {t: references(t, gone) + ([(doomed.columns, doomed)] if t == root else []) for t in group}
        if not rings.intersection(group):
            (t,) = group
            told = _flagged(tables[t], outer[t])
            gone[t], stays[t] = told.where("_hit").drop("_hit"), told.where("not _hit").drop("_hit")
            continue
        held = {t: written(tables[t].withColumn("_no", F.monotonically_increasing_id())) for t in group}
        fresh = {t: written(_flagged(held[t], refs).where("_hit").drop("_hit")) for t, refs in outer.items() if refs}
        found = dict(fresh)
        while fresh:
            hits = {t: _flagged(held[t], refs).where("_hit").drop("_hit") for t in group if (refs := references(t, fresh))}
            hits = {t: written(df.join(found[t].select("_no"), "_no", "left_anti") if t in found else df) for t, df in hits.items()}
            fresh = {t: df for t, df in hits.items() if not df.isEmpty()}
            found |= {t: written(found[t].unionByName(df)) if t in found else df for t, df in fresh.items()}
        for t, df in found.items():
            gone[t], stays[t] = df.drop("_no"), held[t].join(df.select("_no"), "_no", "left_anti").drop("_no")
    spark = doomed.sparkSession
    none = lambda t: spark.range(1).select(F.lit(t).alias("table"), F.lit(0).cast("long").alias("deleted"))
    counts = [gone[t].agg(F.lit(t).alias("table"), F.count("*").alias("deleted")) if t in gone else none(t) for t in tables]
    return stays, reduce(DataFrame.union, counts)


def _flagged(df: DataFrame, references: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """``df`` with ``_hit``: whether a row refers, by its own columns, to one of the rows of any reference."""
    hit = F.lit(False)
    for n, (own, keys) in enumerate(references):
        names = [f"_to_{n}_{i}" for i in range(len(own))]
        df = df.join(keys.toDF(*names).distinct().withColumn(f"_hit_{n}", F.lit(True)), [F.col(o) == F.col(k) for o, k in zip(own, names, strict=True)], "left").drop(*names)
        hit |= F.col(f"_hit_{n}").isNotNull()
    return df.withColumn("_hit", hit).drop(*[f"_hit_{n}" for n in range(len(references))])


def _parents_first(tables: Sequence[str], links: Sequence[tuple], root: str) -> tuple[list[list[str]], set[str]]:
    """The tables that the root reaches, in groups, parents before children, and the tables of rings; a ring is one group."""
    children = {t: {c for c, _, p, _ in links if p == t} for t in tables}
    under: dict[str, set[str]] = {}
    for t in tables:
        seen, todo = set(), [t]
        while todo:
            new = children[todo.pop()] - seen
            seen |= new
            todo += sorted(new)
        under[t] = seen
    left, groups = under[root] | {root}, []
    while left:
        first = next(t for t in sorted(left) if all(o in under[t] or t not in under[o] for o in left))
        groups.append(sorted({first} | {o for o in left if o in under[first] and first in under[o]}))
        left -= set(groups[-1])
    return groups, {t for t in tables if t in under[t]}


def get_or_created(df: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with those of ``rows`` whose key it lacks."""
    return df.unionByName(rows.dropDuplicates(list(on)).join(df, list(on), "left_anti"), allowMissingColumns=True)


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``same``: whether two tables of equal columns hold the same distinct rows."""
    left, right = a.distinct().withColumn("_l", F.lit(1)), b.distinct().withColumn("_r", F.lit(1))
    both = left.join(right, a.columns, "full_outer")
    return both.agg((F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0).alias("same"))


def two_phase(required: DataFrame, outcome: DataFrame, group: str, key: str) -> DataFrame:
    """(group, required, done, may_delete): a group's rows may go only if the set of its
    deleted keys is that of its required ones; a missing object counts as deleted.

    ``required``: group, key. ``outcome``: key, status (deleted, missing or failed).
    """
    wanted = required.where(F.col(key).isNotNull() & (F.col(key) != "")).select(group, F.regexp_replace(F.trim(key), "^/+", "").alias(key)).distinct()
    gone = outcome.where(F.col("status").isin("deleted", "missing")).select(key).distinct().withColumn("_gone", F.lit(1))
    told = wanted.join(gone, key, "left").groupBy(group).agg(F.count("*").alias("required"), F.count("_gone").alias("done"))
    return told.withColumn("may_delete", F.col("required") == F.col("done"))


def registered(wanted: DataFrame, users: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registrations (``seq``, username, email, password_ok) against the users (id, username, email):
    (outcomes, new users, their profiles).

    Requests are met in the order of ``seq``: one is refused for passwords that differ, else for
    a name that is taken, else for a mail that is; of those with one name or mail the
    first that could be created is, and the others find it taken. New ids go on from the greatest one.
    """
    from lattica.operators.ordering import global_position

    names = users.select("username", F.lit(True).alias("_name")).distinct()
    mails = users.select("email", F.lit(True).alias("_mail")).distinct()
    told = wanted.join(names, "username", "left").join(mails, "email", "left")
    refusal = F.when(~F.col("password_ok"), "password mismatch").when(F.col("_name"), "username taken").when(F.col("_mail"), "email taken")
    told = written(told.select(seq, "username", "email", refusal.alias("outcome")))
    allowed = told.where("outcome is null").drop("outcome")
    open_, done = allowed, allowed.limit(0)
    first = lambda by: F.col(seq) == F.min(seq).over(Window.partitionBy(by))
    while True:
        # what is first of its name and of its mail among those still open is created, and shuts the others of either out
        new = written(open_.withColumn("_n", first("username")).withColumn("_m", first("email")).where("_n and _m").drop("_n", "_m"))
        if new.isEmpty():
            break
        done = done.union(new)
        open_ = written(open_.join(new.select("username"), "username", "left_anti").join(new.select("email"), "email", "left_anti").select(seq, "username", "email"))
    by_name = done.select("username", F.col(seq).alias("_username"))
    final = F.coalesce(F.col("outcome") != "email taken", F.lit(False))  # a mail that users have counts only where the name was free still
    met = told.where(~final).join(by_name, "username", "left")
    fate = F.when(F.col("_username") == F.col(seq), "created").when(F.col("_username") < F.col(seq), "username taken").otherwise("email taken")
    outcomes = told.where(final).select(seq, "outcome").union(met.select(seq, fate.alias("outcome")))
    most = users.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    created = global_position(done, [seq], "_row").select((most + F.col("_row") + 1).alias("id"), "username", "email")
    return outcomes, created, created.select(F.col("id").alias("user_id"))


def name_conflicts(wanted: DataFrame, known: DataFrame, remote: DataFrame, name: str = "name") -> DataFrame:
    """Whether a name may be created: its slug is valid and neither the catalogue (ignoring
    case) nor the remote store (exactly) has it."""
    from lattica.functions.predicates import valid_bucket_name
    from lattica.functions.text import slugify

    told = wanted.withColumn("slug", slugify(F.col(name))).withColumn("_ci", F.lower(name))
    ours = known.select(F.lower(name).alias("_ci"), F.lit(True).alias("in_catalogue")).distinct()
    theirs = remote.select(F.col(name).alias("slug"), F.lit(True).alias("in_store")).distinct()
    out = told.join(ours, "_ci", "left").join(theirs, "slug", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_catalogue", "in_store")})
    return out.withColumn("valid", valid_bucket_name(F.col("slug"))).withColumn("may_create", F.col("valid") & ~F.col("in_catalogue") & ~F.col("in_store")).drop("_ci")
