"""Ledger queries: visibility, approvals, expiry, validation, constraints, unique look-ups and batches, on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import ledger as l
from gneiss.plans.catalogue import stamp
from gneiss.plans.registry import query

NOW = "1998-09-02 00:00:00"


@query(f"""
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS received_at, l_extendedprice
    FROM lineitem d JOIN orders u ON l_orderkey = o_orderkey JOIN (SELECT ps, count(*) AS n FROM (SELECT DISTINCT c_custkey AS ps FROM customer WHERE c_acctbal > 0) GROUP BY 1) r ON o_custkey = ps
    WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND l_returnflag = 'A' AND l_tax IS NOT NULL AND l_linestatus = 'F' AND l_shipdate IS NOT NULL AND l_shipdate <= TIMESTAMP '{NOW}'
    ORDER BY l_shipdate DESC, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 200""")
def visible_series(table):
    """Published series: committed, not withdrawn on either side, of the kind, complete, licensed, scheduled and due."""
    lines = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_tax", "l_linestatus")
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    held = table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("reserved")).distinct()
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(held, F.col("o_custkey") == F.col("reserved"))
    shown = l.visible(
        committed=F.col("o_orderstatus") == "F", upload_withdrawn=F.col("o_orderpriority") == "5-LOW", reservation_withdrawn=F.lit(False), kind=F.col("l_returnflag") == "A",
        completed=F.col("l_tax"), licensed=F.col("l_linestatus") == "F", scheduled=F.col("l_shipdate"), now=F.lit(NOW).cast("timestamp_ntz"),
    )
    first = rows.filter(shown).orderBy(F.desc("l_shipdate"), "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").limit(200)
    return first.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stamp("l_shipdate").alias("received_at"), "l_extendedprice")


@query("""
    WITH held AS (SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 7 AS BIGINT) AS token, c_custkey % 4 = 0 AS revoked, 1 AS created FROM customer WHERE c_custkey % 3 <> 0),
    asked AS (SELECT c_custkey AS id, c_mktsegment AS name, CAST(c_custkey % 11 AS BIGINT) AS token FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal > 0)
    SELECT coalesce(h.id, a.id) AS id, coalesce(a.name, h.name) AS name, coalesce(a.token, h.token) AS token, CASE WHEN a.id IS NULL THEN h.revoked ELSE false END AS revoked, coalesce(h.created, 2) AS created, CASE WHEN a.id IS NULL THEN 1 ELSE 2 END AS updated
    FROM held h FULL JOIN asked a ON h.id = a.id""")
def approve_requests(table):
    """Pending requests become registrations: new rows, or existing ones with a new token, un-revoked, first creation kept."""
    c = table("customer")
    held = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7).cast("long").alias("token"), (F.col("c_custkey") % 4 == 0).alias("revoked"), F.lit(1).alias("created"), F.lit(1).alias("updated"))
    asked = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 11).cast("long").alias("token"), F.when(F.col("c_acctbal") > 0, "pending").otherwise("approved").alias("status"))
    return l.approved(held, asked, "id", ["name", "token"], 2)


@query("""
    WITH u AS (SELECT event_id, user_id, CAST(event_id % 5000 AS BIGINT) AS expires, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 9000 AS BIGINT) END AS provisional,
        CASE WHEN event_type = 'error' THEN 'expired' WHEN event_type = 'view' THEN 'uploading' ELSE 'created' END AS status, value > 25 AS completed FROM events)
    SELECT event_id, coalesce(provisional, expires) AS writable_until, CASE WHEN status IN ('created', 'uploading') AND coalesce(provisional, expires) <= 4000 THEN 'expired' WHEN status = 'uploading' AND completed THEN 'checkpointed' ELSE status END AS status,
        sha256(CAST(user_id AS VARCHAR)) || CASE WHEN status = 'expired' OR (status IN ('created', 'uploading') AND coalesce(provisional, expires) <= 4000) THEN ':expired:' || event_id ELSE '' END AS request_hash FROM u""")
def expiry(table):
    """The time rows may be written until, lazy expiry at a bound time, and hashes of expired requests retired."""
    e = table("events")
    kind = F.col("event_type")
    rows = e.select("event_id", (F.col("event_id") % 5000).cast("long").alias("expires"), F.when(kind == "purchase", (F.col("event_id") % 9000).cast("long")).alias("provisional"), F.when(kind == "error", "expired").when(kind == "view", "uploading").otherwise("created").alias("status"), (F.col("value") > 25).alias("completed"), F.sha2(F.col("user_id").cast("string"), 256).alias("hash"))
    until = l.writable_until(F.col("provisional"), F.col("expires"))
    status = l.effective_status(F.col("status"), F.col("completed"), until, F.lit(4000))
    return rows.select("event_id", until.alias("writable_until"), status.alias("status"), l.retired_hash(F.col("hash"), status, F.col("event_id").cast("string")).alias("request_hash"))


@query("""
    SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"' || CASE WHEN o_orderstatus = 'F' THEN ',"priority":"' || o_orderpriority || '"' ELSE '' END || CASE WHEN o_orderstatus <> 'P' THEN ',"customer":' || o_custkey ELSE '' END || '}' AS body FROM orders""")
def sparse_rows(table):
    """Answers that leave out what is missing, and reports without their local fields."""
    o = table("orders")
    report = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer"), F.lit("/home/x").alias("local_path"))
    return o.select("o_orderkey", l.shown(report, ["local_path"]).alias("body"))


@query(r"""
    WITH r AS (SELECT c_custkey, trim(regexp_replace(c_name, '\s+', ' ', 'g')) AS name, lower(replace(c_name, '#', '@')) || '.example' AS email, c_mktsegment AS lab, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END AS plans, c_custkey % 7 <> 0 AS agreed, CASE WHEN c_custkey % 11 = 0 THEN 'v0' ELSE 'v1' END AS version,
        CASE WHEN c_custkey % 13 = 0 THEN ['name', 'extra'] ELSE ['name', 'email'] END AS keys FROM customer)
    SELECT c_custkey, array_to_string(list_filter([CASE WHEN list_contains(keys, 'extra') THEN 'UNKNOWN_FIELD' END, CASE WHEN length(name) NOT BETWEEN 2 AND 17 THEN 'NAME' END, CASE WHEN NOT regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'EMAIL' END,
        CASE WHEN plans IS NULL THEN 'PLANS' END, CASE WHEN NOT agreed THEN 'AGREEMENT' END, CASE WHEN agreed AND version <> 'v1' THEN 'POLICY_UPDATE_REQUIRED' END], lambda x: x IS NOT NULL), ',') AS codes FROM r""")
def request_checks(table):
    """Requests against their validators: every code that applies, in order."""
    c = table("customer")
    k = F.col("c_custkey")
    r = c.select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("@"))), F.lit(".example")).alias("email"), F.when(k % 5 != 0, F.col("c_acctbal") > 0).alias("plans"), (k % 7 != 0).alias("agreed"), F.when(k % 11 == 0, "v0").otherwise("v1").alias("version"), F.when(k % 13 == 0, F.array(F.lit("name"), F.lit("extra"))).otherwise(F.array(F.lit("name"), F.lit("email"))).alias("keys"))
    return r.select("c_custkey", F.array_join(l.request_codes("v1", ["name", "email"], 17), ",").alias("codes"))


@query("""
    WITH b AS (SELECT l_partkey AS series, min(l_orderkey) AS bundle, count(*) AS n FROM lineitem WHERE l_quantity = 1 GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 1 THEN bundle END AS bundle, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'found' END AS lookup FROM part LEFT JOIN b ON series = p_partkey""")
def unique_lookup(table):
    """A look-up by key that says where the key is missing or not unique."""
    bundles = table("lineitem").filter("l_quantity = 1").select(F.col("l_partkey").alias("series"), F.col("l_orderkey").alias("bundle"))
    return l.looked_up(table("part").select("p_partkey"), "p_partkey", bundles, "series", "bundle")


@query("""
    SELECT event_id, s IN (408, 425, 429) OR s BETWEEN 500 AND 599 OR event_type IN ('error') AS api, s = 429 OR s BETWEEN 500 AND 599 AS storage FROM (SELECT event_id, event_type, CAST(400 + event_id % 211 AS INT) AS s FROM events)""")
def retryable_status(table):
    """Which answers of the service and of the store may be tried again."""
    status = (F.lit(400) + F.col("event_id") % 211).cast("int")
    return table("events").select("event_id", l.api_retryable(status, F.col("event_type").isin("error")).alias("api"), l.storage_retryable(status).alias("storage"))


@query("""
    SELECT vec_id, list_transform([1, 4, 5, 2, 6, 3], lambda i: CAST(embedding[i] AS DOUBLE)) AS matrix FROM embeddings""")
def matrix_reorder(table):
    """A symmetric matrix from row order to the vendor's order."""
    return table("embeddings").select("vec_id", l.vendor_matrix(F.transform("embedding", lambda x: x.cast("double"))).alias("matrix"))


@query("""
    WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM f)
    SELECT user_id, list(event_type ORDER BY n) AS values FROM r WHERE n <= 2 GROUP BY 1""")
def two_distinct(table):
    """The first two distinct values of each group: enough to know whether there is more than one."""
    return l.two_distinct(table("events"), "user_id", "event_type", "event_id")


@query("""
    WITH RECURSIVE o AS (SELECT l_suppkey, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax) AS n FROM (SELECT DISTINCT l_suppkey, round(l_discount * 100 + l_tax * 10, 4) AS l_tax FROM lineitem WHERE l_linenumber = 1)),
    g AS (SELECT l_suppkey, n, l_tax AS kept, 1 AS size FROM o WHERE n = 1
        UNION ALL SELECT o.l_suppkey, o.n, CASE WHEN o.l_tax - g.kept > 0.35 THEN o.l_tax ELSE g.kept END, g.size + CASE WHEN o.l_tax - g.kept > 0.35 THEN 1 ELSE 0 END FROM g JOIN o ON o.l_suppkey = g.l_suppkey AND o.n = g.n + 1)
    SELECT l_suppkey, CAST(max(size) AS BIGINT) AS signatures FROM g GROUP BY 1""")
def signature_set(table):
    """Distinct values within a tolerance: in order, each one further than the tolerance from the last kept."""
    values = table("lineitem").filter("l_linenumber = 1").select("l_suppkey", F.round(F.col("l_discount") * 100 + F.col("l_tax") * 10, 4).alias("v"))
    return l.tolerant_distinct(values, "l_suppkey", "v", 0.35).select("l_suppkey", "signatures")


@query("""
    WITH e AS (SELECT user_id, event_id, value::DOUBLE AS v, (event_id % 7)::DOUBLE AS w FROM events WHERE value IS NOT NULL),
    l AS (SELECT user_id, list([v, w] ORDER BY event_id) AS points FROM e GROUP BY 1),
    k AS (SELECT user_id, list_reduce(list_transform(points, lambda p: [p]), lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: abs(q[1] - p[1][1]) <= 12.5 AND abs(q[2] - p[1][2]) <= 2)) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept FROM l)
    SELECT user_id, unnest(kept)[1] AS v, unnest(kept)[2] AS w, unnest(range(1, len(kept) + 1)) AS rank FROM k""")
def first_signatures(table):
    """Distinct pairs within tolerances, in order of first sight: a value is kept unless one kept before agrees with it."""
    points = table("events").select("user_id", "event_id", F.col("value").cast("double").alias("v"), (F.col("event_id") % 7).cast("double").alias("w"))
    return l.first_seen_distinct(points, "user_id", "event_id", ["v", "w"], [12.5, 2.0]).select("user_id", "v", "w", "rank")


@query("""
    WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_linenumber, CAST(l_quantity AS BIGINT) AS length, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - CAST(l_quantity AS BIGINT) AS at_ FROM lineitem)
    SELECT l_orderkey, count(*) = max(l_linenumber) AND min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = count(*) AS complete, bool_and(CASE WHEN i = 1 THEN at_ - l_linenumber + 1 = 0 ELSE l_linenumber > 1 END) AND bool_and(length > 0) AS offsets FROM n GROUP BY 1""")
def part_order(table):
    """Whether a group's numbers are 1 to n, and offsets start at zero and only increase."""
    from gneiss.operators import grouping

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    length = F.col("l_quantity").cast("long")
    lines = grouping.dealt(table("lineitem"), "l_orderkey", table("lineitem").count())
    rows = lines.select("l_orderkey", "l_linenumber", length.alias("length"), F.row_number().over(order).alias("i"), (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("at"))
    rows = rows.withColumn("at", F.when(F.col("i") == 1, F.col("at") - F.col("l_linenumber") + 1).otherwise(F.when(F.col("l_linenumber") > 1, F.col("at")).otherwise(-1)))
    n = F.col("l_linenumber")
    complete = (F.count("*") == F.max(n)) & grouping.complete(n, F.max(n))
    return l.strict_offsets(rows, "l_orderkey", "i", "at", "length", complete.alias("complete"))


@query("""
    SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 1 AND 50, false)) AS failed_checks,
        (SELECT count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL) AS orphans""")
def constraints(table):
    """Unique keys, checks and references of a written table, as counts of violations."""
    return l.violations(table("lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity").between(1, 50), "l_partkey", table("part"), "p_partkey")


@query("""
    WITH a AS (SELECT o_custkey AS path, count(*) AS size, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS digest FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS path, count(*) AS size, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS digest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT count(*) FILTER (WHERE b.path IS NULL) AS missing, count(*) FILTER (WHERE a.path IS NULL) AS extra, count(*) FILTER (WHERE a.size <> b.size OR a.digest <> b.digest) AS changed, CAST(0 AS BIGINT) AS repeated FROM a FULL JOIN b ON a.path = b.path""")
def manifest_equality(table):
    """A manifest against what an archive holds: missing, extra, changed and repeated members; equal if all are zero."""
    of = lambda rows: rows.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("size"), F.sha2(F.max("o_orderkey").cast("string"), 256).alias("digest"))
    return l.manifest_mismatches(of(table("orders")), of(table("orders").filter("o_orderstatus <> 'P'")))


@query("""
    SELECT u.o_orderkey, u.o_orderstatus = 'O' AND d.n IS NOT NULL AND u.o_totalprice > 100000 AS cancelled, coalesce(d.n, 0) AS series FROM orders u LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) d ON l_orderkey = o_orderkey""")
def cancel_staged(table):
    """Uploads that may still be cancelled: staged, within the window, with their series."""
    series = table("lineitem").filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table("orders").join(series, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", l.may_cancel(F.col("o_orderstatus") == "O", F.col("n"), F.col("o_totalprice") > 100000).alias("cancelled"), F.coalesce("n", F.lit(0)).cast("long").alias("series"))
