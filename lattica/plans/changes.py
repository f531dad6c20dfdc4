"""Queries of change sets and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import changes as C
from lattica.sources.tables import table

from .base import query


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (7, 11, 13) THEN 'Completed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_status(spark, sf_dir):
    """New status for a few rows (K2)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return C.updated(o, F.col("o_orderkey").isin(7, 11, 13), {"o_orderstatus": F.lit("Completed")})


@query("SELECT count(*) FILTER (WHERE o_custkey % 10 = 3 AND o_orderstatus = 'O') AS changed FROM orders")
def update_count(spark, sf_dir):
    """How many rows an update changes (K2 A1)."""
    return C.changed_rows(table(spark, sf_dir, "orders"), (F.col("o_custkey") % 10 == 3) & (F.col("o_orderstatus") == "O"))


_REGISTERED = """
WITH users AS (SELECT c_custkey AS id, 'user' || c_custkey % 1000 AS username, 'user' || c_custkey % 1000 || '@example.com' AS email FROM customer WHERE c_acctbal < 0),
wanted AS (SELECT c_custkey AS seq, 'user' || c_custkey % 700 AS username, 'user' || CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 1000 ELSE c_custkey % 700 END || '@example.com' AS email, c_acctbal <= 8000 AS ok FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 700 IN (SELECT id % 1000 FROM users)),
told AS (SELECT *, CASE WHEN NOT ok THEN 'password mismatch' WHEN username IN (SELECT username FROM users) THEN 'username taken' WHEN email IN (SELECT email FROM users) THEN 'email taken' END AS refused FROM wanted),
made AS (SELECT username, min(seq) AS s FROM told WHERE refused IS NULL GROUP BY 1),
done AS (SELECT t.*, CASE WHEN refused IN ('password mismatch', 'username taken') THEN refused WHEN s = seq THEN 'created' WHEN s < seq THEN 'username taken' ELSE 'email taken' END AS outcome FROM told t LEFT JOIN made USING (username))
"""


def _registered(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    mail = lambda m: F.concat(F.lit("user"), m.cast("string"), F.lit("@example.com"))
    users = c.where("c_acctbal < 0").select(n.alias("id"), F.concat(F.lit("user"), (n % 1000).cast("string")).alias("username"), mail(n % 1000).alias("email"))
    wanted = c.select(n.alias("seq"), F.concat(F.lit("user"), (n % 700).cast("string")).alias("username"), mail(F.when(n % 11 == 0, n % 1000).otherwise(n % 700)).alias("email"), (F.col("c_acctbal") <= 8000).alias("password_ok"))
    known = users.select((F.col("id") % 1000).alias("_k")).distinct()
    wanted = wanted.join(known, F.col("seq") % 700 == F.col("_k"), "left").where("seq % 11 <> 0 or _k is not null").drop("_k")
    return C.registered(wanted, users)


@query(_REGISTERED + "SELECT seq, outcome FROM done")
def registration_outcomes(spark, sf_dir):
    """Registrations met one after the other: what becomes of each."""
    return _registered(spark, sf_dir)[0]


@query(_REGISTERED + "SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id, username, email FROM done WHERE outcome = 'created'")
def registration_rows(spark, sf_dir):
    """The users that registrations add, with ids that go on from the greatest."""
    return _registered(spark, sf_dir)[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_ids(spark, sf_dir):
    """Rows without those whose key is in a set (K3 K8)."""
    keys = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return C.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


_LINKS = [("nation", ["n_regionkey"], "region", ["r_regionkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"])]

_CASCADE = """
WITH n AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 7)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)), l AS (SELECT *, l_orderkey IN (SELECT * FROM o) OR l_suppkey IN (SELECT * FROM s) AS gone FROM lineitem)
"""


def _cascade(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    return C.cascade(tables, _LINKS, "nation", tables["nation"].where("n_nationkey in (3, 7)").select("n_nationkey"))


@query(_CASCADE + """SELECT 'region' AS "table", CAST(0 AS BIGINT) AS deleted UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM s
UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l WHERE gone""")
def cascade_counts(spark, sf_dir):
    """Rows that go from each table when two nations do, by five foreign keys (K3 A1)."""
    return _cascade(spark, sf_dir)[1]


@query(_CASCADE + """SELECT 'customer' AS "table", c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT * FROM c) UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o)
UNION ALL SELECT 'lineitem', l_orderkey FROM l WHERE NOT gone""")
def cascade_survivors(spark, sf_dir):
    """What stays of the tables after a cascading delete (K3)."""
    stays = _cascade(spark, sf_dir)[0]
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return reduce(DataFrame.union, [stays[t].select(F.lit(t).alias("table"), F.col(k).cast("long").alias("key")) for t, k in keys.items()])


@query("""
SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 4000
UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal <= 4000 AND s_nationkey < 15
""")
def get_or_create(spark, sf_dir):
    """Rows added where their key is missing (K5 K1)."""
    s = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "id", "s_name": "name"})
    return C.get_or_created(s.where("s_acctbal > 4000").select("id", "name"), s.where("s_nationkey < 15").select("id", "name"), ["id"])


@query("""
SELECT s_suppkey AS id, coalesce(CASE WHEN s_nationkey > 12 THEN 'new ' || s_name END, s_name) AS name, s_nationkey AS region FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT -s_suppkey, 'added', -1 FROM supplier WHERE s_acctbal < 0
""")
def grid_edit(spark, sf_dir):
    """Insert, update and delete of grid items."""
    s = table(spark, sf_dir, "supplier")
    n = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("region"))
    edits = n.select("id", F.when(F.col("region") > 12, F.concat(F.lit("new "), "name")).alias("name"))
    gone = n.where("id % 5 = 0").select("id")
    added = s.where("s_acctbal < 0").select((-F.col("s_suppkey")).alias("id"), F.lit("added").alias("name"))
    return C.inserted(C.deleted(C.merged(n, edits, ["id"]), gone, ["id"]), added).fillna(-1, ["region"])


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new ' || p_brand ELSE p_brand END AS c, p_size AS d, p_type AS e, CASE WHEN p_size > 40 THEN ['first', 'none'] || string_split(p_name, ' ')[3:] WHEN p_size > 25 THEN ['first'] || string_split(p_name, ' ')[2:] ELSE string_split(p_name, ' ') END AS tags,
       CASE WHEN p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS price, CASE WHEN p_size > 25 THEN 7.0::DOUBLE END AS tax
FROM part
""")
def grid_edit_deep(spark, sf_dir):
    """Edits of nested items: one field of a struct, places of an array, keys of a map."""
    p = table(spark, sf_dir, "part")
    some = p.where("p_size > 25")
    inner = F.struct(F.struct(F.col("p_brand").alias("c"), F.col("p_size").alias("d")).alias("b"), F.col("p_type").alias("e"))
    items = p.select("p_partkey", inner.alias("a"), F.split("p_name", " ").alias("tags"), F.create_map(F.lit("price"), F.col("p_retailprice")).alias("m"))
    tags = F.when(F.col("p_size") > 40, F.array(F.lit("first"), F.lit("none"))).otherwise(F.array(F.lit("first")))
    edits = some.select("p_partkey", F.struct(F.struct(F.concat(F.lit("new "), "p_brand").alias("c")).alias("b")).alias("a"), tags.alias("tags"), F.create_map(F.lit("price"), F.col("p_retailprice") + 1, F.lit("tax"), F.lit(7.0)).alias("m"))
    out = C.deep_merged(items, edits, ["p_partkey"])
    return out.select("p_partkey", F.col("a.b.c").alias("c"), F.col("a.b.d").alias("d"), F.col("a.e").alias("e"), "tags", F.col("m")["price"].alias("price"), F.col("m")["tax"].alias("tax"))


@query("""
WITH need AS (SELECT DISTINCT o_custkey AS id, 'video/' || o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P'), gone AS (SELECT 'video/' || o_orderkey AS key FROM orders WHERE o_totalprice < 400000)
SELECT id, count(*) AS required, count(g.key) AS done, count(*) = count(g.key) AS may_delete FROM need LEFT JOIN gone g USING (key) GROUP BY id
""")
def two_phase_delete_ok(spark, sf_dir):
    """Rows that may go because all their objects are gone."""
    o = table(spark, sf_dir, "orders")
    need = o.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" /video/"), F.col("o_orderkey").cast("string"))).alias("key"))
    status = F.when(F.col("o_totalprice") >= 400000, "failed").when(F.col("o_orderpriority") == "5-LOW", "missing").otherwise("deleted")
    outcome = o.select(F.concat(F.lit("video/"), F.col("o_orderkey").cast("string")).alias("key"), status.alias("status"))
    return C.two_phase(need, outcome, "id", "key")


@query("""
SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS same
""")
def set_equality(spark, sf_dir):
    """Whether two sets are equal."""
    return C.same_set(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT x FROM (SELECT l_linenumber AS x FROM lineitem UNION SELECT p_size FROM part)")
def union_of_x(spark, sf_dir):
    """The union of the x of two series (U4)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x")).union(table(spark, sf_dir, "part").select("p_size")).distinct()


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT event_id, event_type FROM events")
def bag_union(spark, sf_dir):
    """Concatenation of lists, repeats kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return o.unionByName(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status")))


@query("""
SELECT p_brand AS label, min(p_partkey) AS first_at FROM part GROUP BY 1
""")
def unique_labels(spark, sf_dir):
    """Every label once, with where it appears first."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.min("p_partkey").alias("first_at"))


@query("""
WITH h AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'Processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'failed' ELSE 'uncompleted' END AS status FROM events),
l AS (SELECT *, lower(status) AS s, coalesce(lower(lag(status) OVER (PARTITION BY task_id ORDER BY seq)), 'uncompleted') AS b FROM h)
SELECT task_id, seq, status, b || '>' || s IN ('uncompleted>processing', 'processing>completed', 'processing>failed', 'failed>processing') AS valid FROM l
""")
def status_steps(spark, sf_dir):
    """Which events are steps of the status workflow."""
    from lattica.streaming.status import valid_steps

    kind = F.col("event_type")
    status = F.when(kind == "click", "Processing").when(kind == "view", "processing").when(kind == "purchase", "Completed").when(kind == "error", "failed").otherwise("uncompleted")
    return valid_steps(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status")))
