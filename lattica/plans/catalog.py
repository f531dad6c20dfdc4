"""Queries of the catalogue: lists, lookups, the source library and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.functions import predicates as P
from lattica.functions import text as X
from lattica.operators import aggregates, joins, ordering
from lattica.sources import listing, sinks
from lattica.sources.tables import table
from lattica.sources.written import shared_folder

from .base import query


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos,
       CAST(1 AS BIGINT) AS page, CAST(greatest(1, ceil((SELECT count(*) FROM orders) / 10.0)) AS BIGINT) AS n_pages
FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10)
""")
def list_page(spark, sf_dir):
    """Scan, newest first, first page of ten."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ordering.page(rows, [F.col("o_orderkey").desc()], 1)


@query("""
WITH n AS (SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS n_pages FROM customer),
numbered AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT c_custkey, c_name, pos, n_pages AS page, n_pages FROM numbered, n WHERE pos >= (n_pages - 1) * 10
""")
def page_last_clamped(spark, sf_dir):
    """A page number out of range gives the last page (O2)."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ordering.page(rows, [F.col("c_custkey")], 99_999_999, reverse=[F.col("c_custkey").desc()])


@query("""
SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, CAST(1 AS BIGINT) AS page,
       CAST(greatest(1, ceil((SELECT count(*) FROM supplier) / 10.0)) AS BIGINT) AS n_pages
FROM supplier QUALIFY pos < 10
""")
def page_not_a_number(spark, sf_dir):
    """A page that is no whole number is page 1 (O2)."""
    return ordering.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), [F.col("s_suppkey")], "first")


@query("SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders")
def server_table_order(spark, sf_dir):
    """A table whole, newest first, with positions (O3, global positions without a single-task window)."""
    return ordering.global_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")])


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def ordinal_positions(spark, sf_dir):
    """Every order's place in the order of dates (W12 over a whole table)."""
    return ordering.global_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def take_first(spark, sf_dir):
    """The first element of an order."""
    return ordering.first_row(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def iexact_lookup(spark, sf_dir):
    """Equality without case (F2)."""
    return table(spark, sf_dir, "customer").where(P.iexact(F.col("c_name"), "CUSTOMER#000000042")).select("c_custkey", "c_name")


@query("SELECT count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_finished FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 999999999)")
def id_in_list(spark, sf_dir):
    """Rows whose id is in a list, counted."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21, 999999999))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def exists_flags(spark, sf_dir):
    """Whether each customer has orders."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_has", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(keys, "c_custkey", "left").select("c_custkey", F.coalesce("_has", F.lit(False)).alias("has_orders"))


@query("SELECT count(*) AS found, max(o_orderstatus) AS status, count(*) = 1 AS one FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    """A point lookup and whether it found exactly one row."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderkey") == 7)
    return rows.agg(F.count("*").alias("found"), F.max("o_orderstatus").alias("status")).withColumn("one", F.col("found") == 1)


@query("SELECT DISTINCT source AS name FROM documents")
def name_scan(spark, sf_dir):
    """One column, its distinct values."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()


def _objects(spark, sf_dir):
    """Documents as objects: the source is the bucket; every fifth key is no image."""
    ext = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".jpeg", ".txt", ".gif"))), (F.col("doc_id") % 5 + 1).cast("int"))
    key = F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), ext)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), key.alias("key"), "doc_id")


_OBJECTS_SQL = """
objects AS (
  SELECT source AS bucket, doc_id,
         lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || ['.png', '.JPG', '.jpeg', '.txt', '.gif'][CAST(doc_id % 5 + 1 AS INTEGER)] AS key
  FROM documents
)
"""


def _image_urls(spark, sf_dir):
    """(bucket, key, url) of the images in buckets that the catalogue names."""
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("bucket"))
    found = _objects(spark, sf_dir).where(P.has_suffix(F.col("key"), P.IMAGES)).join(named, "bucket", "left_semi")
    return found.select("bucket", "key", X.object_url(F.col("bucket"), F.col("key")).alias("url"))


@query(f"""
WITH {_OBJECTS_SQL}, named AS (SELECT 'src' || n_nationkey AS bucket FROM nation),
images AS (SELECT * FROM objects WHERE bucket IN (SELECT bucket FROM named) AND regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg)$')),
urls AS (SELECT bucket, key, 'https://' || bucket || '.s3.amazonaws.com/' || key AS url FROM images),
picks AS (
  SELECT bucket, arg_min(url, key) AS first_url, arg_min(url, sha256(key)) AS pick, count(*) AS n_images,
         string_agg(url, ' ' ORDER BY key) AS urls FROM urls GROUP BY bucket
), general AS (SELECT arg_min(url, sha256(url)) AS url FROM urls)
SELECT n.bucket, coalesce(n_images, 0) AS n_images, first_url, coalesce(pick, (SELECT url FROM general)) AS thumbnail,
       sha256(coalesce(urls, '')) AS urls_sha256
FROM named n LEFT JOIN picks USING (bucket)
""")
def source_library(spark, sf_dir):
    """The source library: catalogue names met with stored buckets, images by suffix, a
    fixed pick for each bucket, all URLs in the order of their keys (as the SHA-256 of their
    text; as rows in ``source_urls``), and a general fallback (E3: J4 J5 A3 A4 A5 F6 U1)."""
    urls = _image_urls(spark, sf_dir)
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("bucket"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    picks = urls.groupBy("bucket").agg(F.min_by("url", "key").alias("first_url"), F.min_by("url", sha(F.col("key"))).alias("thumbnail"), F.count("*").alias("n_images"))
    general = urls.agg(F.min_by("url", sha(F.col("url"))).alias("thumbnail"))
    all_urls = aggregates.joined_sha256(urls, ["bucket"], ["key"], "url", name="urls_sha256")
    out = joins.with_fallback(named.join(picks.drop("thumbnail"), "bucket", "left"), picks, ["bucket"], "thumbnail", general).join(all_urls, "bucket", "left")
    return out.select("bucket", F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images"), "first_url", "thumbnail", F.coalesce("urls_sha256", sha(F.lit(""))).alias("urls_sha256"))


@query(f"""
WITH {_OBJECTS_SQL}, named AS (SELECT 'src' || n_nationkey AS bucket FROM nation)
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS pos, 'https://' || bucket || '.s3.amazonaws.com/' || key AS url
FROM objects WHERE bucket IN (SELECT bucket FROM named) AND regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg)$')
""")
def source_urls(spark, sf_dir):
    """All URLs of every source, in the order of their keys (A5)."""
    return ordering.keyed_position(_image_urls(spark, sf_dir), ["bucket"], ["key"]).select("bucket", "pos", "url")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) INTERSECT SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def semi_join_names(spark, sf_dir):
    """Names in the catalogue and in the store."""
    n = table(spark, sf_dir, "nation")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"))
    supplied = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return n.join(rich, "n_nationkey", "left_semi").select(F.col("n_name").alias("name")).intersect(n.join(supplied, "n_nationkey", "left_semi").select("n_name"))


@query(f"""
WITH {_OBJECTS_SQL}, wanted AS (SELECT unnest(['src3', 'src11', 'none', 'src0']) AS bucket, unnest([0, 1, 2, 3]) AS bucket_pos)
SELECT bucket, key, doc_id, CAST(bucket_pos AS BIGINT) AS bucket_pos, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS pos
FROM objects JOIN wanted USING (bucket)
""")
def multi_bucket_scan(spark, sf_dir):
    """Objects of several buckets in the order of selection; a missing bucket adds nothing."""
    return listing.selected(_objects(spark, sf_dir), ["src3", "src11", "none", "src0"])


@query(f"""
WITH {_OBJECTS_SQL}
SELECT doc_id, regexp_extract(key, '([^/]*)$', 1) AS base, lower(regexp_extract(key, '(\\.[^./]*)$', 1)) AS ext,
       regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg)$') AS image, regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg|\\.gif)$') AS sample,
       CASE WHEN lower(regexp_extract(key, '(\\.[^./]*)$', 1)) IN ('.png', '.jpg', '.jpeg') THEN 'image'
            WHEN lower(regexp_extract(key, '(\\.[^./]*)$', 1)) = '.gif' THEN 'gif' ELSE 'unsupported' END AS kind
FROM objects
""")
def suffix_filter(spark, sf_dir):
    """Base name, extension, suffix filters and dispatch by media type."""
    key, ext = F.col("key"), X.extension(F.col("key"))
    return _objects(spark, sf_dir).select("doc_id", X.base_name(key).alias("base"), ext.alias("ext"), P.has_suffix(key, P.IMAGES).alias("image"), P.has_suffix(key, P.SAMPLES).alias("sample"), P.media_kind(ext).alias("kind"))


@query(f"""
WITH {_OBJECTS_SQL}
SELECT bucket || '/' || key AS path, ntile_no AS batch, count(*) OVER (PARTITION BY bucket) AS batch_size,
       count(*) OVER (PARTITION BY bucket) <= 50 AS accepted
FROM (SELECT *, bucket AS ntile_no FROM objects)
""")
def upload_and_archive(spark, sf_dir):
    """Paths in an archive of buckets, and uploads refused above 50 files."""
    files = sinks.archive_paths(_objects(spark, sf_dir)).withColumn("batch", F.col("bucket"))
    return sinks.upload_batches(files).select("path", "batch", "batch_size", "accepted")


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, count(*) OVER (PARTITION BY o_custkey) > 12 AS refused FROM orders)
SELECT o_orderkey, CASE WHEN refused THEN 'too many files' WHEN o_totalprice < 50000 THEN 'empty file' WHEN o_orderstatus = 'P' THEN 'unknown type' END AS error FROM f
""")
def upload_outcomes(spark, sf_dir):
    """Uploads file by file: one that fails hinders no other of its batch."""
    faults = {"empty file": F.col("o_totalprice") < 50000, "unknown type": F.col("o_orderstatus") == "P"}
    return sinks.upload_outcomes(table(spark, sf_dir, "orders"), "o_custkey", faults, 12).select("o_orderkey", "error")


@query("SELECT 'size=' || p_size AS bucket, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part GROUP BY 1")
def stored_listing(spark, sf_dir):
    """Text files written by bucket to the shared folder, listed with their sizes, without a page limit."""
    root = f"{shared_folder(spark)}/lattica-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), "p_name").write.partitionBy("size").text(root)
    return listing.objects(spark, root, [".txt"]).groupBy("bucket").agg(F.sum("size").alias("bytes"))


@query("""
SELECT 'b' || p_size % 4 AS bucket, TRUE AS ok, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part GROUP BY ALL UNION ALL SELECT 'missing', FALSE, NULL UNION ALL SELECT 'unreadable', FALSE, NULL
""")
def isolated_listing(spark, sf_dir):
    """Buckets listed together, two of which cannot be: they are told and skipped."""
    root = f"{shared_folder(spark)}/lattica-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_size") % 4).alias("bucket"), "p_name").write.partitionBy("bucket").text(root)
    roots = {"b2": f"{root}/bucket=b2", "missing": f"{root}/bucket=none", "b0": f"{root}/bucket=b0", "unreadable": f"nostore://{uuid.uuid4().hex}/x", "b1": f"{root}/bucket=b1", "b3": f"{root}/bucket=b3"}
    files, told = listing.isolated(spark, roots, [".txt"])
    return told.join(files.groupBy("bucket").agg(F.sum("size").alias("bytes")), "bucket", "left").select("bucket", "ok", "bytes")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def jdbc_scan(spark, sf_dir):
    """A catalogue in a database, read in four ranges of its key with the filter pushed down.

    The database is an embedded one of this process, so the query is for a local session."""
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("an embedded database is open to one process: use listing.jdbc_parts with the url of a server")
    url = f"jdbc:derby:memory:parts{uuid.uuid4().hex};create=true"
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").write.format("jdbc").option("url", url).option("dbtable", "parts").save()
    return listing.jdbc_parts(spark, url, "parts", "p_partkey", 4).where("p_size > 40").select("p_partkey", "p_name")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 2 THEN 'jpeg' ELSE 'gif' END AS kind FROM documents WHERE text IS NOT NULL AND doc_id % 5 IN (0, 2, 3)")
def valid_image_files(spark, sf_dir):
    """Files that are whole images by their first and last bytes; cut, other and missing ones are dropped."""
    n, text, png = F.col("doc_id") % 5, F.col("text").cast("binary"), F.unhex(F.lit(listing.SIGNATURES["png"]))
    whole = F.when(n == 0, F.concat(png, text, F.unhex(F.lit(listing.PNG_END)))).when(n == 1, F.concat(png, text))
    content = whole.when(n == 2, F.concat(F.unhex(F.lit(listing.SIGNATURES["jpeg"])), text)).when(n == 3, F.concat(F.unhex(F.lit(listing.SIGNATURES["gif"])), text))
    files = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(content)).alias("content"))  # a generator's column is worked out once
    return listing.valid_images(files).select("doc_id", listing.image_kind(F.col("content")).alias("kind"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 2 THEN 'jpeg' ELSE 'gif' END AS kind, CASE doc_id % 6 WHEN 0 THEN 640 WHEN 3 THEN 320 END::BIGINT AS width, CASE doc_id % 6 WHEN 0 THEN doc_id % 1000 + 1 WHEN 3 THEN doc_id % 200 + 1 END::BIGINT AS height
FROM documents WHERE text IS NOT NULL AND doc_id % 6 IN (0, 2, 3)
""")
def whole_image_files(spark, sf_dir):
    """Image files whole from header to end, with the sizes that their headers tell."""
    n, text = F.col("doc_id") % 6, F.col("text").cast("binary")
    raw = lambda *parts: F.concat(*[F.unhex(p if not isinstance(p, str) else F.lit(p)) if p is not text else p for p in parts])
    big = lambda v: F.lpad(F.hex(v), 8, "0")
    little = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256).cast("long")), 2, "0"))
    png = lambda h: (listing.SIGNATURES["png"], "0000000D49484452", big(F.lit(640)), big(h))
    content = F.when(n == 0, raw(*png(F.col("doc_id") % 1000 + 1), text, listing.PNG_END)).when(n == 1, raw(*png(F.lit(0)), text, listing.PNG_END))
    content = content.when(n == 2, raw(listing.SIGNATURES["jpeg"], text, "FFD90000")).when(n == 3, raw(listing.SIGNATURES["gif"], "3961", little(F.lit(320)), little(F.col("doc_id") % 200 + 1), text, "003B")).when(n == 4, raw(listing.SIGNATURES["jpeg"], text))
    files = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(content)).alias("content"))  # a generator's column is worked out once
    return listing.whole_images(files).select("doc_id", "kind", "width", "height")


@query("""
WITH types AS (SELECT c_mktsegment AS model, min(c_custkey) AS id FROM customer GROUP BY 1), a AS (SELECT unnest(['add', 'change', 'delete', 'view']) AS act, unnest([0, 1, 2, 3]) AS k)
SELECT c_custkey AS user_id, id * 4 + k AS permission_id, 'Can ' || act || ' ' || lower(model) AS name, act || '_' || lower(model) AS codename FROM customer JOIN types ON c_mktsegment = model, a WHERE k < 1 + c_nationkey % 4
""")
def dump_rows(spark, sf_dir):
    """Rows of a dump met by their declared keys: users, their permissions, the permissions' content types."""
    c = table(spark, sf_dir, "customer")
    types = c.groupBy(F.col("c_mktsegment").alias("model")).agg(F.min("c_custkey").alias("content_type_id"))
    actions = F.posexplode(F.array(*map(F.lit, ("add", "change", "delete", "view")))).alias("k", "act")
    permissions = types.select("content_type_id", F.lower("model").alias("m"), actions)
    permissions = permissions.select((F.col("content_type_id") * 4 + F.col("k")).alias("permission_id"), "content_type_id", F.concat(F.lit("Can "), "act", F.lit(" "), "m").alias("name"), F.concat("act", F.lit("_"), "m").alias("codename"))
    granted = c.join(types, F.col("c_mktsegment") == F.col("model")).select(F.col("c_custkey").alias("user_id"), F.explode(F.sequence(F.lit(0), F.col("c_nationkey") % 4)).alias("k"), "content_type_id")
    granted = granted.select("user_id", (F.col("content_type_id") * 4 + F.col("k")).alias("permission_id"))
    return granted.join(permissions, "permission_id").select("user_id", "permission_id", "name", "codename")


@query("""
SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, regexp_matches(lower(replace(p_name, ' ', '-')), '^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$') AS valid,
       CASE WHEN p_size < 5 THEN NULL ELSE 'https://example.com/' || ltrim(p_brand, '/') END AS page_url,
       'https://' || lower(replace(p_name, ' ', '-')) || '.s3.amazonaws.com/' || p_partkey || '.jpg' AS url,
       p_partkey || '_resized.jpg' AS resized, lower(replace(p_type, '-', '_')) AS kind,
       coalesce(nullif(CASE WHEN p_size > 35 THEN '' ELSE p_brand END, ''), substr(sha256(p_partkey::VARCHAR), 1, 8)) AS own_slug
FROM part
""")
def slug_url_columns(spark, sf_dir):
    """Slugs, name rule, URLs and paths."""
    slug, key = X.slugify(F.col("p_name")), F.col("p_partkey").cast("string")
    base = F.when(F.col("p_size") < 5, "").otherwise("https://example.com//")
    given = F.when(F.col("p_size") > 35, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", slug.alias("slug"), P.valid_bucket_name(slug).alias("valid"), X.join_url(base, F.concat(F.lit("/"), F.col("p_brand"))).alias("page_url"),
        X.object_url(slug, F.concat(key, F.lit(".jpg"))).alias("url"), X.resized_path(F.concat(key, F.lit(".jpg"))).alias("resized"), X.type_name(F.col("p_type")).alias("kind"), X.slug_or_token(given, key).alias("own_slug"),
    )


@query("""
SELECT o_orderkey, 'composition_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '_' || substr(sha256(o_orderkey::VARCHAR), 1, 6) AS name,
       'rtl_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '_' || substr(sha256(o_orderkey::VARCHAR), 1, 6) AS rtl_name
FROM orders
""")
def auto_name(spark, sf_dir):
    """Generated names with a fixed suffix."""
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.auto_name("composition", at, key).alias("name"), X.auto_name("rtl", at, key).alias("rtl_name"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, replace(event_type, '-', '_') AS kind, array_to_string([event_type], ',') AS kinds
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 40
""")
def json_prop_filter(spark, sf_dir):
    """A JSON body parsed and filtered, a scalar as a list."""
    body = F.from_json("props", "k long")
    rows = table(spark, sf_dir, "events").withColumn("k", body["k"]).where("k between 10 and 40")
    return rows.select("event_id", "k", X.type_name(F.col("event_type")).alias("kind"), F.array_join(F.array("event_type"), ",").alias("kinds"))


@query("""
WITH wanted AS (SELECT c_custkey, c_name AS username, lower(c_name) || '@example.com' AS email, c_acctbal > 8000 AS mismatch FROM customer),
known AS (SELECT c_name AS username FROM customer WHERE c_mktsegment = 'BUILDING'), mails AS (SELECT lower(c_name) || '@example.com' AS email FROM customer WHERE c_acctbal < 0)
SELECT c_custkey, CASE WHEN mismatch THEN 'password mismatch' WHEN username IN (SELECT username FROM known) THEN 'username taken'
                       WHEN email IN (SELECT email FROM mails) THEN 'email taken' ELSE 'created' END AS outcome
FROM wanted
""")
def registration(spark, sf_dir):
    """Outcome of registrations: mismatch, taken name, taken mail, created."""
    c = table(spark, sf_dir, "customer")
    mail = F.concat(F.lower("c_name"), F.lit("@example.com"))
    wanted = c.select("c_custkey", F.col("c_name").alias("username"), mail.alias("email"), (F.col("c_acctbal") > 8000).alias("mismatch"))
    names = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("username"), F.lit(True).alias("_name")).distinct()
    mails = c.where("c_acctbal < 0").select(mail.alias("email"), F.lit(True).alias("_mail")).distinct()
    told = wanted.join(names, "username", "left").join(mails, "email", "left")
    outcome = F.when(F.col("mismatch"), "password mismatch").when(F.col("_name"), "username taken").when(F.col("_mail"), "email taken").otherwise("created")
    return told.select("c_custkey", outcome.alias("outcome"))


@query("""
SELECT c_custkey, c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING' AS staff,
       c_name IS NOT NULL AND c_name <> '' AND c_mktsegment IS NOT NULL AND c_mktsegment <> '' AS complete
FROM customer
""")
def role_filter(spark, sf_dir):
    """Role and completeness guards."""
    staff = F.col("c_acctbal").isNotNull() & (F.col("c_mktsegment") == "BUILDING")
    return table(spark, sf_dir, "customer").select("c_custkey", staff.alias("staff"), (P.filled(F.col("c_name")) & P.filled(F.col("c_mktsegment"))).alias("complete"))


@query("""
SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name
""")
def fk_joins(spark, sf_dir):
    """Traversal of foreign keys."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    each = c.groupBy("c_nationkey").agg(F.count("*").alias("_n"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(each, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("_n", F.lit(0)).cast("long").alias("customers"))


@query("""
WITH wanted AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part), told AS (SELECT name, lower(replace(name, ' ', '-')) AS slug FROM wanted),
known AS (SELECT DISTINCT upper(p_type || ' ' || p_name) AS name FROM part WHERE p_size < 5), remote AS (SELECT DISTINCT lower(replace(p_type || ' ' || p_name, ' ', '-')) AS name FROM part WHERE p_size > 48)
SELECT name, slug, EXISTS (SELECT 1 FROM known k WHERE lower(k.name) = lower(t.name)) AS in_catalogue, slug IN (SELECT name FROM remote) AS in_store,
       regexp_matches(slug, '^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$') AS valid,
       regexp_matches(slug, '^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$') AND NOT EXISTS (SELECT 1 FROM known k WHERE lower(k.name) = lower(t.name)) AND slug NOT IN (SELECT name FROM remote) AS may_create
FROM told t
""")
def bucket_conflicts(spark, sf_dir):
    """Which buckets may be created."""
    from lattica.operators.changes import name_conflicts

    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_type", F.lit(" "), "p_name"))
    known = p.where("p_size < 5").select(F.upper("name").alias("name"))
    remote = p.where("p_size > 48").select(X.slugify(F.col("name")).alias("name"))
    return name_conflicts(p.select("name").distinct(), known, remote)


@query(f"""
WITH {_OBJECTS_SQL}, n AS (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY key) AS no FROM objects)
SELECT bucket, no * 2 - 1 AS line_no, 'file ''' || key || '''' AS line FROM n UNION ALL SELECT bucket, no * 2, 'duration 1' FROM n
UNION ALL SELECT bucket, max(no) * 2 + 1, 'file ''' || arg_max(key, no) || '''' FROM n GROUP BY bucket
""")
def concat_manifest(spark, sf_dir):
    """Manifest lines for all files of each bucket, the last one repeated."""
    return sinks.manifest(_objects(spark, sf_dir), ["bucket"], order="key", path="key")


@query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS no FROM orders)
SELECT CAST(0 AS BIGINT) AS line_no, '"o_orderkey","o_orderpriority","o_custkey"' AS line UNION ALL SELECT no, '"' || o_orderkey || '","' || o_orderpriority || '","' || o_custkey || '"' FROM n
UNION ALL SELECT count(*) + 1, '"' || count(*) || '","","' || max(o_custkey) || '"' FROM n
""")
def csv_export(spark, sf_dir):
    """A whole export in order, with header and footer."""
    return sinks.delimited_lines(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority", "o_custkey"], footer={"o_orderkey": F.count("*"), "o_custkey": F.max("o_custkey")})


@query("""
SELECT c_custkey, '"' || replace(c_name, '"', '""') || '","' || c_nationkey || '","' || replace('say "' || c_name || '"', '"', '""') || '"' AS line,
       '"' || c_name || '"' || chr(9) || '"' || c_nationkey || '"' AS tab_line
FROM customer
""")
def csv_line(spark, sf_dir):
    """Delimited lines, quotes doubled."""
    n = table(spark, sf_dir, "customer").withColumn("said", F.concat(F.lit('say "'), "c_name", F.lit('"')))
    return n.select("c_custkey", sinks.delimited(n, ["c_name", "c_nationkey", "said"]).alias("line"), sinks.delimited(n, ["c_name", "c_nationkey"], sep="\t").alias("tab_line"))


@query("""
WITH f AS (SELECT source, doc_id, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents)
SELECT source, doc_id, path, 'merged_' || lpad((row_number() OVER (PARTITION BY source ORDER BY path) - 1)::VARCHAR, 6, '0') AS frame FROM f
""")
def numbered_frames(spark, sf_dir):
    """Names by position of all files of a bucket in the order of their paths."""
    from lattica.operators.windows import frame_name

    path = F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    files = table(spark, sf_dir, "documents").select("source", "doc_id", path.alias("path"))
    numbered = ordering.keyed_position(files, ["source"], ["path"])
    return numbered.select("source", "doc_id", "path", frame_name(F.col("pos"), "merged", 6).alias("frame"))


_FRAMES_SQL = f"""
WITH {_OBJECTS_SQL}, bg AS (SELECT bucket, key AS bg_key, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS pos FROM objects WHERE NOT starts_with(key, 'fr/') AND regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg)$')),
fg AS (SELECT bucket, key AS fg_key, row_number() OVER (PARTITION BY bucket ORDER BY key DESC) - 1 AS pos FROM objects WHERE starts_with(key, 'fr/') AND regexp_matches(lower(key), '(\\.png|\\.jpg|\\.jpeg)$')),
plan AS (SELECT bucket, pos, 'merged_' || lpad(pos::VARCHAR, 3, '0') AS name, bg_key, fg_key, pos * 1000 AS "start", pos * 1000 + 1000 AS "end" FROM bg JOIN fg USING (bucket, pos))
"""


def _frames(spark, sf_dir):
    from lattica.operators import composition

    objects = _objects(spark, sf_dir).withColumnRenamed("key", "object")
    return composition.frames(objects.where("not startswith(object, 'fr/')"), objects.where("startswith(object, 'fr/')"), ["bucket"], right_to_left=True)


@query(_FRAMES_SQL + "SELECT * FROM plan")
def composition_plan(spark, sf_dir):
    """The right-to-left frame plan of a composition for each bucket (E2: F6 J2 W1 W2)."""
    return _frames(spark, sf_dir)


@query(_FRAMES_SQL + """SELECT a.bucket, a.pos // 2 AS pair, a.name AS first_name, b.name AS second_name, 'frame_' || lpad((a.pos // 2)::VARCHAR, 4, '0') AS name
FROM plan a JOIN plan b ON a.bucket = b.bucket AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0""")
def composition_composites(spark, sf_dir):
    """Frames two in one (E2: J3)."""
    from lattica.operators import composition

    return composition.composites(_frames(spark, sf_dir), ["bucket"])
