"""Catalogue queries: listings, joins, set comparisons, writes and states on the driver's star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import ids, numbers, text
from gneiss.operators import relations, state
from gneiss.plans.registry import query

SECOND = "%Y-%m-%d %H:%M:%S"


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


@query("""
    SELECT o_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS published_at, c_name, l_partkey, l_extendedprice,
        CASE WHEN l_shipdate <= TIMESTAMP '1998-09-02' THEN 'published' ELSE 'staged' END AS publication
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' AND l_shipdate <= TIMESTAMP '1998-09-02'
    ORDER BY l_shipdate DESC, o_orderkey, l_linenumber, l_partkey, l_extendedprice, c_name LIMIT 200""")
def archive_listing(table):
    """Published rows over three joined tables, newest first, 200 at most."""
    now = F.lit("1998-09-02").cast("timestamp_ntz")
    lines = table("lineitem").filter(F.col("l_shipdate") <= now)
    orders = table("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    first = relations.top(joined, 200, F.desc("l_shipdate"), "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "c_name")
    return first.select("o_orderkey", "l_linenumber", stamp("l_shipdate").alias("published_at"), "c_name", "l_partkey", "l_extendedprice", relations.publication(F.col("l_shipdate"), now).alias("publication"))


@query("""
    SELECT c_custkey, n_name, r_name, CASE WHEN o.n IS NULL THEN 'never' WHEN o.open > 0 THEN 'active' ELSE 'closed' END AS registration
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def device_context(table):
    """Inner joins to small dimensions and an outer join to an aggregate, with a three-valued state."""
    orders = table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    places = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    registration = F.when(F.col("n").isNull(), "never").when(F.col("open") > 0, "active").otherwise("closed")
    return joined.select("c_custkey", "n_name", "r_name", registration.alias("registration"))


@query("""
    SELECT e.event_id, e.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS created_at,
        EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts < e.ts) AS has_upload
    FROM events e WHERE e.event_type = 'error'
        AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts)""")
def unfinished_runs(table):
    """Failed runs with no later finished run of the same source, and whether an upload came before."""
    events = table("events")
    open_ = relations.latest_without_later(events.filter("event_type = 'error'"), events.filter("event_type = 'purchase'"), "user_id", "ts")
    first = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_upload"))
    joined = open_.join(first, "user_id", "left")
    return joined.select("event_id", "user_id", stamp("ts").alias("created_at"), F.coalesce(F.col("first_upload") < F.col("ts"), F.lit(False)).alias("has_upload"))


@query("""
    SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_orderkey FROM customer""")
def first_child_value(table):
    """A scalar subquery: the first child's value, as an aggregate and a left join."""
    first = table("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_orderkey"))
    return table("customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "first_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join_reset(table):
    """Rows with a child that meets a condition."""
    return table("customer").join(table("orders").filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
    WITH a AS (SELECT l_orderkey AS o_orderkey, CASE WHEN max(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) = 0 THEN 'F'
        WHEN min(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) = 1 THEN 'O' ELSE 'P' END AS o_orderstatus FROM lineitem GROUP BY 1)
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'missing'
        WHEN a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'changed' END AS state
    FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(table):
    """Recorded order states against those that their lines say."""
    is_open = (F.col("l_linestatus") == "O").cast("int")
    status = F.when(F.max(is_open) == 0, "F").when(F.min(is_open) == 1, "O").otherwise("P")
    after = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(status.alias("o_orderstatus"))
    return relations.snapshot_diff(table("orders"), after, "o_orderkey", ["o_orderstatus"])


@query("""
    SELECT coalesce(a.k, f.k) AS orderkey, coalesce(a.n, 0) AS asked, coalesce(f.n, 0) AS found
    FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY 1) f ON a.k = f.k""")
def set_reconcile(table):
    """Requested against found keys with counts, in one aggregation."""
    asked = table("orders").select(F.col("o_orderkey").alias("orderkey"))
    found = table("lineitem").select(F.col("l_orderkey").alias("orderkey")).distinct()
    return relations.reconcile(asked, found, "orderkey")


@query("""
    SELECT o_orderkey, o_orderpriority, n AS n_lines, list_sort(list_filter(generate_series(1, top), lambda x: NOT list_contains(have, x))) AS missing
    FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def part_gaps(table):
    """Numbers missing from 1 to the highest one, by group."""
    lines = table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max("l_linenumber").alias("top"), F.collect_set("l_linenumber").alias("have"))
    missing = F.expr("array_sort(transform(array_except(sequence(1, top), have), x -> cast(x as bigint)))")
    return table("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", "n_lines", missing.alias("missing"))


@query("""
    SELECT c_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18, 2)) END), 0) AS DOUBLE) AS used
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def quota_usage(table):
    """Sum over children of some states, zero without any."""
    used = table("orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = table("customer").join(used, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("used"))


@query("""
    SELECT o_orderkey, replace(replace(replace(c_name, chr(9), ' '), chr(13), ' '), chr(10), ' ') AS folder, o_orderpriority AS kind,
        row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS place
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def review_index(table):
    """Places in a listing with unknown numbers last, cells cleaned for a tab-separated file."""
    number = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    joined = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(number.asc_nulls_last(), "o_orderkey"))
    return joined.select("o_orderkey", text.table_cell(F.col("c_name")).alias("folder"), F.col("o_orderpriority").alias("kind"), place.cast("long").alias("place"))


@query("""
    WITH old AS (SELECT o_custkey AS k, min(o_orderkey) AS id, min(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    new AS (SELECT o_custkey AS k, max(o_orderkey) AS id, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(old.k, new.k) AS custkey, CASE WHEN old.k IS NOT NULL THEN old.id ELSE new.id END AS id,
        CASE WHEN new.k IS NOT NULL THEN new.price ELSE old.price END AS price FROM old FULL JOIN new ON old.k = new.k""")
def upsert_latest(table):
    """Insert or update by key: the old id stays, the new price replaces."""
    orders = table("orders").withColumn("custkey", F.col("o_custkey"))
    old = orders.filter("o_orderstatus = 'F'").groupBy("custkey").agg(F.min("o_orderkey").alias("id"), F.min("o_totalprice").alias("price"))
    new = orders.filter("o_orderstatus = 'O'").groupBy("custkey").agg(F.max("o_orderkey").alias("id"), F.max("o_totalprice").alias("price"))
    return state.upsert(old, new, "custkey", ["id"], ["price"])


@query("""
    SELECT user_id, event_type, event_id AS last_event, value AS last_value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(table):
    """The last row of each key."""
    rows = table("events").select("user_id", "event_type", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"), "ts")
    return state.latest(rows, ["user_id", "event_type"], F.col("ts"), F.col("last_event")).drop("ts")


@query("""
    WITH f AS (SELECT *, first_value(event_id) OVER w AS first_id, first_value(props) OVER w AS first_props, first_value(value) OVER w AS first_value
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT event_id, user_id, event_type, CASE WHEN event_id = first_id THEN 'created' WHEN first_value > 40 THEN 'tombstone'
        WHEN props = first_props THEN 'already_received' ELSE 'conflict' END AS decision FROM f""")
def first_writer_wins(table):
    """Reservations: the first writer of a key decides what later ones are told."""
    rows = table("events").withColumn("arrival", F.struct("ts", "event_id"))
    decided = state.first_writer(rows, ["user_id", "event_type"], F.col("props"), F.col("arrival"), F.col("value") > 40)
    return decided.select("event_id", "user_id", "event_type", "decision")


@query("""
    SELECT o_orderkey, CASE WHEN hit THEN 'expired' ELSE o_orderstatus END AS status, hit AS changed
    FROM (SELECT *, o_orderstatus = 'O' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1999-01-01' AS hit FROM orders)""")
def cas_transition(table):
    """Lazy expiry: a conditional update with a bound time, and which rows it changed."""
    rows = table("orders").withColumn("status", F.col("o_orderstatus"))
    late = (F.col("status") == "O") & (F.expr("o_orderdate + interval 90 days") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    return state.compare_and_set(rows, "status", late, F.lit("expired")).select("o_orderkey", "status", "changed")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS at_ FROM events),
    g(user_id, at_) AS (SELECT user_id, min(at_) FROM e GROUP BY user_id
        UNION ALL SELECT g.user_id, (SELECT min(e.at_) FROM e WHERE e.user_id = g.user_id AND e.at_ >= g.at_ + 600000000) FROM g
            WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = g.user_id AND e.at_ >= g.at_ + 600000000))
    SELECT user_id, at_ AS granted_at FROM g""")
def lease_grants(table):
    """Exclusive leases of ten minutes, granted in order of request."""
    rows = table("events").select("user_id", micros("ts").alias("granted_at"))
    return state.lease_grants(rows, "user_id", "granted_at", numbers.LEASE * 1_000_000)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderdate + INTERVAL 7 DAY <= TIMESTAMP '2001-07-01' THEN 'published' ELSE 'staged' END AS publication FROM orders""")
def publication_state(table):
    """Staged for seven days, then published; no schedule, no state."""
    scheduled = F.when(F.col("o_orderstatus") != "P", F.expr("o_orderdate + interval 7 days"))
    return table("orders").select("o_orderkey", relations.publication(scheduled, F.lit("2001-07-01").cast("timestamp_ntz")).alias("publication"))


@query("""
    WITH s AS (SELECT user_id, event_type, ts, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS done,
        max(ts) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS failed, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
    SELECT user_id, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS updated_at, CASE WHEN max(done) IS NULL THEN 'uploading'
        WHEN max(failed) > max(done) THEN 'withdrawn' WHEN max(last) = max(done) THEN 'committed' ELSE 'checkpointed' END AS status FROM s GROUP BY user_id""")
def lifecycle_fold(table):
    """The final state of each upload from its events."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    status = F.when(at("purchase").isNull(), "uploading").when(at("error") > at("purchase"), "withdrawn").when(F.max("ts") == at("purchase"), "committed").otherwise("checkpointed")
    return table("events").groupBy("user_id").agg(stamp(F.max("ts")).alias("updated_at"), status.alias("status"))


@query("""
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    p(o_custkey, o_orderkey, n, chunk, items, bytes) AS (SELECT o_custkey, o_orderkey, n, 0, 1, size FROM o WHERE n = 1
        UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, CASE WHEN p.items + 1 > 4 OR p.bytes + o.size > 600000 THEN p.chunk + 1 ELSE p.chunk END,
            CASE WHEN p.items + 1 > 4 OR p.bytes + o.size > 600000 THEN 1 ELSE p.items + 1 END,
            CASE WHEN p.items + 1 > 4 OR p.bytes + o.size > 600000 THEN o.size ELSE p.bytes + o.size END
        FROM p JOIN o ON o.o_custkey = p.o_custkey AND o.n = p.n + 1)
    SELECT o_custkey, o_orderkey, chunk FROM p""")
def bin_pack(table):
    """Greedy chunks of consecutive rows under an item and a size limit."""
    rows = table("orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    return state.pack_in_order(rows, "o_custkey", ["o_orderkey"], "size", 4, 600_000).select("o_custkey", "o_orderkey", "chunk")


@query("""
    SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN length(c_name) NOT BETWEEN 2 AND 18 THEN 'name_length' END,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_segment' END], lambda x: x IS NOT NULL) AS problems
    FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100""")
def access_review(table):
    """The first hundred requests with the codes of what is wrong with each."""
    bad = lambda c, code: F.when(c, code)
    name = text.human_label(F.col("c_name"), 18)
    problems = F.array_compact(F.array(bad(F.col("c_acctbal") < 0, "negative_balance"), bad(name.isNull(), "name_length"), bad(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "unknown_segment")))
    return relations.top(table("customer"), 100, F.col("c_acctbal"), F.col("c_custkey")).select("c_custkey", problems.alias("problems"))


@query("""
    SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE NOT (e.event_type = 'signup' AND EXISTS (
        SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'view' AND f.ts < e.ts))""")
def audit_log(table):
    """An append rule: entries that came too late for their subject are ignored."""
    events = table("events")
    seen = events.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("seen_at"))
    late = (F.col("event_type") == "signup") & F.coalesce(F.col("seen_at") < F.col("ts"), F.lit(False))
    return events.join(seen, "user_id", "left").filter(~late).select("event_id", "user_id", "event_type")


@query("""
    WITH k AS (SELECT event_id, props, json_keys(props) AS keys, TRY_CAST(props->>'k' AS BIGINT) AS n FROM events)
    SELECT event_id, len(list_filter(keys, lambda x: x <> 'k')) AS unknown_keys, list_contains(keys, 'k') AS has_key, coalesce(n BETWEEN 0 AND 80, false) AS in_range FROM k""")
def strict_json(table):
    """Objects with exactly the known keys and a number in range."""
    keys = F.json_object_keys("props")
    n = F.get_json_object("props", "$.k").try_cast("long") if hasattr(F.col("x"), "try_cast") else F.get_json_object("props", "$.k").cast("long")
    unknown = F.size(F.array_except(keys, F.array(F.lit("k"))))
    return table("events").select("event_id", unknown.cast("long").alias("unknown_keys"), F.array_contains(keys, "k").alias("has_key"), F.coalesce(n.between(0, 80), F.lit(False)).alias("in_range"))


@query("""
    SELECT e.event_id, sha256('{"id":' || e.event_id || ',"kind":"' || e.event_type || '","user":' || e.user_id || '}') AS request_hash FROM events e""")
def request_hash(table):
    """Hash of canonical JSON, which repeats for a repeated request."""
    return table("events").select("event_id", ids.canonical_hash(id=F.col("event_id"), kind=F.col("event_type"), user=F.col("user_id")).alias("request_hash"))


@query("""
    SELECT user_id, day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS running FROM
        (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)""")
def running_offsets(table):
    """Running sums over ordered parts."""
    daily = table("events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("running", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")))
