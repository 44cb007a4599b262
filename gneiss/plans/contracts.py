"""Contract and ledger queries: bounds, child sets, coverage, declared counts, decisions and resumed runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import contracts, grouping, rules
from gneiss.plans.registry import query


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, name, value, CASE name WHEN 'quantity' THEN value BETWEEN 1 AND 40 WHEN 'discount' THEN value BETWEEN 0 AND 0.08 ELSE false END AS in_bounds
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount', l_discount FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'tax', l_tax FROM lineitem)""")
def value_bounds(table):
    """Numeric values against a table of bounds by name."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax"))])
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.inline(cells))
    return contracts.within_bounds(rows, "name", "value", [("quantity", 1.0, 40.0), ("discount", 0.0, 0.08)])


@query("""
    SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'] AS complete, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O'] AS settled FROM orders GROUP BY 1""")
def child_sets(table):
    """Groups whose children are exactly the wanted ones."""
    status = F.col("o_orderstatus")
    return table("orders").groupBy("o_custkey").agg(contracts.has_exactly(status, ["P", "O", "F"]).alias("complete"), contracts.has_exactly(status, ["F", "O"]).alias("settled"))


@query("""
    SELECT o_orderkey, (shared = 1 AND frames = 0) OR (shared = 0 AND frames = n) AS covered FROM (
        SELECT o_orderkey, CASE WHEN max(o_orderpriority) = '1-URGENT' THEN 1 ELSE 0 END AS shared, count(*) FILTER (l_returnflag = 'N') AS frames, count(*) AS n
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def macro_coverage(table):
    """A macro is shared by all frames or given in each, never both or some."""
    frames = table("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("frames"), F.count("*").alias("n"))
    shared = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    joined = table("orders").join(frames, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_orderkey", contracts.shared_or_all(shared, F.col("frames"), F.col("n")).alias("covered"))


@query("""
    SELECT l_suppkey, l_partkey, CAST(bool_or(l_returnflag = 'A') AS INT) + CAST(bool_or(l_returnflag = 'N') AS INT) + CAST(bool_or(l_returnflag = 'R') AS INT) = 1 AS one_kind FROM lineitem GROUP BY 1, 2""")
def one_kind(table):
    """Exactly one of several exclusive kinds is present in a group."""
    flags = [F.bool_or(F.col("l_returnflag") == f) for f in "ANR"]
    return table("lineitem").groupBy("l_suppkey", "l_partkey").agg(contracts.exactly_one(flags).alias("one_kind"))


@query("""
    SELECT o_orderkey, coalesce(n, 0) AS found, coalesce(n, 0) = declared AS as_declared FROM
        (SELECT o_orderkey, CAST(4 AS BIGINT) AS declared FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def declared_counts(table):
    """Children found against the number a parent declares."""
    parents = table("orders").select("o_orderkey", F.lit(4).cast("long").alias("declared"))
    return contracts.declared(parents, "o_orderkey", "declared", table("lineitem"), "l_orderkey").drop("declared")


@query("""
    SELECT p_partkey AS partkey, CASE WHEN count(*) = count(c) AND count(DISTINCT c) = 1 THEN min(c) END AS flag FROM
        (SELECT l_partkey AS p_partkey, CASE WHEN l_returnflag IN ('A', 'R') THEN lower(l_returnflag) END AS c FROM lineitem) GROUP BY 1""")
def safe_metadata(table):
    """A group's value only where every row has a canonical one and all agree."""
    canonical = F.when(F.col("l_returnflag").isin("A", "R"), F.lower("l_returnflag"))
    return table("lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(grouping.safe_value(canonical, F.col("l_returnflag")).alias("flag"))


@query("""
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, printf('dicom/%06d.dcm', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS member
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def member_names(table):
    """Numbered member names of each series' files in their order."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    size = table("lineitem").count()  # of Parquet's footers
    lines, orders = grouping.dealt(table("lineitem"), "l_orderkey", size), grouping.dealt(table("orders").select("o_orderkey"), "o_orderkey", size)
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("dicom/%06d.dcm", n).alias("member"))


@query("""
    WITH s AS (SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS BIGINT) AS raw, CAST(round(sum(CAST(l_quantity AS DECIMAL(18, 2)))) AS BIGINT) AS packed FROM lineitem GROUP BY 1)
    SELECT l_orderkey, raw <= 20 * greatest(packed, 5000) AS accepted FROM s""")
def expansion_guard(table):
    """Archives that would grow beyond twenty times their size, or a floor, are refused."""
    whole = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,2)"))).cast("long")
    sizes = table("lineitem").groupBy("l_orderkey").agg(whole("l_extendedprice").alias("raw"), whole("l_quantity").alias("packed"))
    return sizes.select("l_orderkey", (F.col("raw") <= 20 * F.greatest(F.col("packed"), F.lit(5000))).alias("accepted"))


@query("""
    WITH r AS (SELECT user_id, props, min(event_id) AS first, count(*) FILTER (event_type = 'error') AS withdrawn FROM events GROUP BY 1, 2)
    SELECT e.event_id, CASE WHEN e.value < 1 THEN 'invalid' WHEN r.first = e.event_id THEN 'create' WHEN r.withdrawn > 0 THEN 'tombstone' WHEN e.value > 45 THEN 'conflict' ELSE 'replay' END AS decision
    FROM events e JOIN r ON r.user_id = e.user_id AND r.props = e.props""")
def create_decision(table):
    """An idempotent create as a decision table over earlier requests of the same hash."""
    events = table("events")
    known = events.groupBy("user_id", "props").agg(F.min("event_id").alias("first"), F.count_if(F.col("event_type") == "error").alias("withdrawn"))
    gates = [
        rules.Rule(F.col("value") < 1, "invalid", ""),
        rules.Rule(F.col("first") == F.col("event_id"), "create", ""),
        rules.Rule(F.col("withdrawn") > 0, "tombstone", ""),
        rules.Rule(F.col("value") > 45, "conflict", ""),
    ]
    return events.join(known, ["user_id", "props"]).select("event_id", rules.decide(gates, "replay", "").getField("decision").alias("decision"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unchanged' WHEN o_orderstatus = 'F' AND o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-06-01' AND o_orderdate <= TIMESTAMP '1998-06-01' THEN 'withdrawn'
        WHEN o_orderstatus = 'F' THEN 'too_late' ELSE 'not_received' END AS outcome FROM orders""")
def cancel_in_window(table):
    """Cancellation inside the publication delay only, and idempotent."""
    now, at = F.lit("1998-06-01").cast("timestamp_ntz"), F.col("o_orderdate")
    open_ = (F.expr("o_orderdate + interval 7 days") > now) & (at <= now)
    status = F.col("o_orderstatus")
    outcome = F.when(status == "P", "unchanged").when((status == "F") & open_, "withdrawn").when(status == "F", "too_late").otherwise("not_received")
    return table("orders").select("o_orderkey", outcome.alias("outcome"))


@query("""
    SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'finished' WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN 'superseded' ELSE 'resumable' END AS run FROM events""")
def resumed_runs(table):
    """Interrupted runs are superseded by the next run of the same source; the last one can be resumed."""
    later = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    run = F.when(F.col("event_type") == "purchase", "finished").when(later.isNotNull(), "superseded").otherwise("resumable")
    return table("events").select("event_id", "user_id", run.alias("run"))


@query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')""")
def cascade_delete(table):
    """The next snapshot of children after some parents are deleted."""
    gone = table("orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    kept = table("lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
    SELECT count(*) AS files, count(DISTINCT user_id) AS series, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS held,
        count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS excluded FROM events""")
def summary_counters(table):
    """Counters of a run in one aggregation."""
    kind = F.col("event_type")
    return table("events").agg(
        F.count("*").alias("files"), F.count_distinct("user_id").alias("series"), F.count_if(kind == "purchase").alias("accepted"),
        F.count_if(kind == "error").alias("held"), F.count_if(~kind.isin("purchase", "error")).alias("excluded"),
    )


@query("""
    WITH s AS (SELECT p_partkey, (CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 3 ELSE 0 END) + (CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END) AS score FROM part)
    SELECT p_partkey, score, least(0.95, 0.9 + 0.01 * least(score, 5)) AS confidence FROM s""")
def confidence_score(table):
    """Points of evidence and the bounded confidence they give."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("p_type") == "PROMO", 2) + points(F.col("p_size") > 25, 3) + points(F.col("p_name").contains("red"), 1)
    return table("part").select("p_partkey", score.alias("score"), rules.confidence(score).alias("confidence"))


@query("""
    SELECT user_id, done, total - done AS left, CASE WHEN done - base > 0 THEN round((total - done) * span / (done - base), 3) END AS eta FROM
        (SELECT user_id, count(*) FILTER (event_type <> 'error') AS done, count(*) AS total, count(*) FILTER (event_type = 'signup') AS base, CAST(date_diff('second', min(ts), max(ts)) AS DOUBLE) AS span FROM events GROUP BY 1)""")
def progress_eta(table):
    """Time left at the rate since a resumed run's start, not counting what was done before."""
    kind = F.col("event_type")
    rows = table("events").groupBy("user_id").agg(
        F.count_if(kind != "error").alias("done"), F.count("*").alias("total"), F.count_if(kind == "signup").alias("base"),
        F.expr("cast(timestampdiff(SECOND, date_trunc('SECOND', min(ts)), date_trunc('SECOND', max(ts))) as double)").alias("span"),
    )
    rate = F.col("done") - F.col("base")
    eta = F.when(rate > 0, F.round((F.col("total") - F.col("done")) * F.col("span") / rate, 3))
    return rows.select("user_id", "done", (F.col("total") - F.col("done")).alias("left"), eta.alias("eta"))
