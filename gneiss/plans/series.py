"""Series queries: grouped aggregation, contracts over order, classification and redaction on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import ids, numbers, text
from gneiss.operators import grouping, rules
from gneiss.plans.catalogue import micros
from gneiss.plans.registry import query

KEY = b"gneiss demonstration key"


def _hmac_sql(message: str, key: bytes = KEY) -> str:
    """DuckDB SQL for the hex HMAC-SHA256 of a BLOB expression."""
    block = key.ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ p:02X}" for b in block) for p in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || {message})))"


def _pseudonym_sql(namespace: str, value: str) -> str:
    prefix = "v1\\x00" + namespace + "\\x00"
    message = f"'{prefix}'::BLOB || encode(trim({value}))"
    return f"substr({_hmac_sql(message)}, 1, 24)"


@query(f"""
    SELECT c_custkey, {_pseudonym_sql('subject', 'c_name')} AS subject_id, {_pseudonym_sql('session', "c_mktsegment || '/' || c_custkey")} AS session_id FROM customer""")
def pseudonym_ids(table):
    """Keyed identifiers, as expressions only."""
    session = F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string"))
    return table("customer").select("c_custkey", ids.pseudonym(KEY, "subject", F.col("c_name")).alias("subject_id"), ids.pseudonym(KEY, "session", session).alias("session_id"))


@query(f"""
    SELECT p_partkey, '2.25.' || CAST(('0x' || substr(h, 1, 12))::HUGEINT * 281474976710656 + ('0x' || substr(h, 13, 12))::HUGEINT AS VARCHAR) AS uid
    FROM (SELECT p_partkey, {_pseudonym_sql('uid', "'1.2.' || p_partkey")} AS h FROM part)""")
def uid_remap(table):
    """Unique identifiers as decimal numbers from a keyed digest."""
    return table("part").select("p_partkey", ids.remapped_uid(KEY, F.concat(F.lit("1.2."), F.col("p_partkey").cast("string"))).alias("uid"))


@query("""
    SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS label,
        upper(trim(regexp_replace('  ' || p_name || '   x ', '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS normal,
        list_contains(regexp_split_to_array(p_brand, '[^A-Za-z0-9]'), '7') AS token_7 FROM part""")
def normalize_labels(table):
    """Protocol labels, normal text and whole tokens."""
    return table("part").select(
        "p_partkey",
        text.protocol_label(F.concat_ws(" - ", "p_name", "p_type")).alias("label"),
        text.normal_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("normal"),
        text.has_token(F.col("p_brand"), ["7"]).alias("token_7"),
    )


@query("""
    SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'Widgets' WHEN contains(p_name, 'ring') THEN 'Rings' WHEN contains(lower(p_brand), 'brand#1') THEN 'House' ELSE upper(p_type) END AS vendor FROM part""")
def canonical_vendor(table):
    """Ordered contains-rules to a canonical name, else bounded text."""
    rules_ = [("widget", "Widgets"), ("ring", "Rings")]
    house = text.first_match(F.col("p_brand"), [("brand#1", "House")], F.upper("p_type"))
    return table("part").select("p_partkey", text.first_match(F.col("p_name"), rules_, house).alias("vendor"))


@query("""
    SELECT p_partkey, nullif(array_to_string(list_distinct_ordered, chr(92)), '') AS codes FROM (
        SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
            SELECT p_partkey, list_filter(string_split(upper(p_name || ' ' || p_type || ' ' || p_name), ' '), lambda x: x IN ('RED', 'SMALL', 'WIDGET', 'ECONOMY')) AS l FROM part))""")
def code_list(table):
    """Allowed codes of a list, in order, each once."""
    return table("part").select("p_partkey", text.code_list(F.concat_ws(" ", "p_name", "p_type", "p_name"), ["RED", "SMALL", "WIDGET", "ECONOMY"], " ").alias("codes"))


@query(r"""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(x) BETWEEN 1 AND 160 AND regexp_full_match(x, '[A-Za-z0-9 ._+()/-]+')
        AND NOT (regexp_matches(x, '(?i)://|www\.|@|^/|/.*/|\.\.') OR regexp_matches(x, '(?i)(^|[^a-z])(name|patient|dob|mrn|ssn|id)[^a-z]?') OR regexp_matches(x, '[0-9]{7}')) THEN x END AS label FROM t""")
def bounded_text(table):
    """Free text kept only where it can be no personal data."""
    return table("conversations").select("conv_id", "turn", text.bounded_label(F.col("text"), 160).alias("label"))


@query("""
    WITH v AS (SELECT o_orderkey, o_custkey, CAST(o_custkey % 3 AS INT) AS a, CAST(o_orderkey % 4 AS INT) AS b, CAST(o_orderkey % 10 AS INT) AS c, CASE WHEN o_orderstatus = 'P' THEN '-rc.1' ELSE '' END AS pre FROM orders)
    SELECT o_custkey, max_by(a || '.' || b || '.' || c || pre, (a, b, c, CASE WHEN pre = '' THEN 1 ELSE 0 END, pre)) AS newest FROM v GROUP BY 1""")
def semver_compare(table):
    """The newest semantic version of each group; pre-releases sort below their release."""
    pre = F.when(F.col("o_orderstatus") == "P", "-rc.1").otherwise("")
    version = F.concat(F.concat_ws(".", (F.col("o_custkey") % 3).cast("string"), (F.col("o_orderkey") % 4).cast("string"), (F.col("o_orderkey") % 10).cast("string")), pre)
    return table("orders").withColumn("version", version).groupBy("o_custkey").agg(F.max_by("version", text.version_key(F.col("version"))).alias("newest"))


@query("""
    WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice * 1000000) AS BIGINT) AS size FROM orders),
    p AS (SELECT *, greatest(67108864, ((CAST(ceil(CAST(size AS DECIMAL(20, 0)) / 10000) AS BIGINT) + 1048575) // 1048576) * 1048576) AS part FROM s)
    SELECT o_orderkey, part AS part_size, greatest(1, (size + part - 1) // part) AS parts, size - (greatest(1, (size + part - 1) // part) - 1) * part AS last_size FROM p""")
def part_plan(table):
    """Part size, number of parts and the last part's size of a multipart upload."""
    size = F.round(F.col("o_totalprice") * 1_000_000).cast("long")
    rows = table("orders").select("o_orderkey", size.alias("size"))
    return rows.select("o_orderkey", numbers.part_size(F.col("size")).alias("part_size"), numbers.part_count(F.col("size")).alias("parts"), numbers.last_part(F.col("size")).alias("last_size"))


@query("""
    SELECT coalesce(NULLIF(event_type, ''), 'missing:' || event_id) AS series, user_id, count(*) AS files, count(*) FILTER (value > 30) AS large, bool_or(value > 49) AS any_huge, bool_and(value > 0) AS all_positive,
        count(*) <> count(DISTINCT props) AS duplicate_props, max(value) - min(value) > 40 AS spread FROM events GROUP BY 1, 2""")
def series_summary(table):
    """Counts, any, all, duplicates and spread of each series."""
    key = grouping.isolated(F.col("event_type"), F.col("event_id").cast("string"))
    return table("events").groupBy(key.alias("series"), "user_id").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("value") > 30).alias("large"),
        F.bool_or(F.col("value") > 49).alias("any_huge"),
        F.bool_and(F.col("value") > 0).alias("all_positive"),
        (F.count("*") != F.count_distinct("props")).alias("duplicate_props"),
        (F.max("value") - F.min("value") > 40).alias("spread"),
    )


@query("""
    WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS known, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS number FROM orders)
    SELECT o_custkey, (SELECT x.o_orderkey FROM r x WHERE x.o_custkey = r.o_custkey ORDER BY coalesce(CAST(floor(x.number) AS BIGINT), 9223372036854775807), x.o_orderkey LIMIT 1) AS representative,
        (SELECT x.known FROM r x WHERE x.o_custkey = r.o_custkey AND x.known IS NOT NULL ORDER BY coalesce(CAST(floor(x.number) AS BIGINT), 9223372036854775807), x.o_orderkey LIMIT 1) AS priority
    FROM r GROUP BY o_custkey""")
def representative(table):
    """The row of the lowest number (unknown last), and values it lacks from the next in order."""
    rows = table("orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).withColumn("number", F.when(F.col("o_orderstatus") != "F", F.floor("o_totalprice")))
    number, path = F.col("number"), F.col("o_orderkey")
    return rows.groupBy("o_custkey").agg(grouping.representative(F.col("o_orderkey"), number, path).alias("representative"), grouping.first_known(F.col("known"), number, path).alias("priority"))


@query("""
    WITH f AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, user_id) AS n FROM f)
    SELECT event_type, list(CASE WHEN n <= 64 THEN CAST(user_id AS VARCHAR) ELSE 'unknown-overflow' END ORDER BY n) AS values FROM r WHERE n <= 65 GROUP BY 1""")
def bounded_distinct(table):
    """Distinct values in order of first sight, 64 of them and an overflow mark."""
    return grouping.bounded_distinct(table("events"), "event_type", "user_id", "event_id", 64, "unknown-overflow")


@query("""
    SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS status_conflict, count(DISTINCT coalesce(p, chr(0))) > 1 AS strict_conflict, count(DISTINCT p) > 1 AS conflict
    FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS p FROM orders) GROUP BY 1""")
def consistency(table):
    """Conflicts within a series; for some attributes being missing conflicts too."""
    rows = table("orders").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    p = F.col("p")
    return rows.groupBy("o_custkey").agg(grouping.conflict(F.col("o_orderstatus")).alias("status_conflict"), grouping.conflict(p, True).alias("strict_conflict"), grouping.conflict(p).alias("conflict"))


@query("""
    SELECT l_suppkey, count(*) // count(DISTINCT (round(l_discount * 1000000), round(l_tax * 1000000), l_linenumber)) >= 2 AS repeated FROM lineitem GROUP BY 1""")
def repeated_positions(table):
    """Whether measured positions repeat, rounded to micrometres."""
    position = F.struct(F.round(F.col("l_discount") * 1_000_000), F.round(F.col("l_tax") * 1_000_000), "l_linenumber")
    rows = table("lineitem").select("l_suppkey", position.alias("position"))
    return rows.groupBy("l_suppkey").agg(grouping.repeated(F.col("position"), F.count("*")).alias("repeated"))


@query("""
    SELECT l_orderkey, CAST(sum(b) + 2 * max(b) + 67108864 AS BIGINT) AS need FROM (SELECT l_orderkey, CAST(round(l_extendedprice * 1000) AS BIGINT) AS b FROM lineitem) GROUP BY 1""")
def staging_need(table):
    """Space to stage a series."""
    rows = table("lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 1000).cast("long").alias("b"))
    return rows.groupBy("l_orderkey").agg(grouping.staging_need(F.col("b")).alias("need"))


@query("""
    WITH d AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, min(epoch_us(ts)) AS at_, max(event_id) AS acquisition FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(at_) OVER w AS prior, lag(acquisition) OVER w AS acq_prior, first_value(at_) OVER w AS first_at, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY user_id ORDER BY hour))
    SELECT user_id, count(*) AS steps, bool_and(coalesce(at_ > prior, true)) AS increasing, bool_and(coalesce(acquisition > acq_prior, true)) AS acquisitions_increase,
        bool_and(abs(at_ - (first_at + (k - 1) * 3600000000)) <= 7200000000) AS on_time FROM l GROUP BY 1""")
def timing_contract(table):
    """Begin times by step: increasing, in step with the acquisitions, near their expected time."""
    hour = F.expr("cast(at_us div 3600000000 as bigint)")
    steps = table("events").select("user_id", "event_id", micros("ts").alias("at_us")).groupBy("user_id", hour.alias("hour")).agg(F.min("at_us").alias("at"), F.max("event_id").alias("acquisition"))
    w = Window.partitionBy("user_id").orderBy("hour")
    rows = steps.select("user_id", "at", "acquisition", F.lag("at").over(w).alias("before"), F.lag("acquisition").over(w).alias("acq_before"), F.first("at").over(w).alias("first"), F.row_number().over(w).alias("k"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("steps"),
        F.bool_and(F.coalesce(F.col("at") > F.col("before"), F.lit(True))).alias("increasing"),
        F.bool_and(F.coalesce(F.col("acquisition") > F.col("acq_before"), F.lit(True))).alias("acquisitions_increase"),
        F.bool_and(F.abs(F.col("at") - (F.col("first") + (F.col("k") - 1) * F.lit(3_600_000_000))) <= 7_200_000_000).alias("on_time"),
    )


@query("""
    WITH s AS (SELECT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem),
    c AS (SELECT *, min(CASE WHEN step <> i THEN i END) OVER (PARTITION BY l_orderkey) AS cycle FROM s)
    SELECT l_orderkey, coalesce(max(cycle), count(*)) AS cycle, bool_and(step = CASE WHEN cycle IS NULL THEN i WHEN cycle = 0 THEN -1 ELSE i % cycle END) AS cyclic FROM c GROUP BY 1""")
def cycle_check(table):
    """Whether numbers run through one cycle again and again."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("step"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    broken = F.min(F.when(F.col("step") != F.col("i"), F.col("i"))).over(Window.partitionBy("l_orderkey"))
    expected = F.when(F.col("cycle").isNull(), F.col("i")).when(F.col("cycle") == 0, -1).otherwise(F.expr("i % nullif(cycle, 0)"))
    return rows.withColumn("cycle", broken).groupBy("l_orderkey").agg(F.coalesce(F.max("cycle"), F.count("*")).alias("cycle"), F.bool_and(F.col("step") == expected).alias("cyclic"))


@query("""
    WITH f AS (SELECT o_custkey, o_orderkey, o_orderkey || '|' || CAST(round(o_totalprice) AS BIGINT) || '|' || sha256(o_orderpriority) AS line FROM orders)
    SELECT o_custkey, sha256('folder-v1' || chr(10) || count(*) || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey)) AS fingerprint FROM f GROUP BY 1""")
def folder_fingerprint(table):
    """One hash for a folder's files in order of path."""
    rows = table("orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"), F.sha2("o_orderpriority", 256).alias("digest"))
    return grouping.fingerprint(rows, "o_custkey", "o_orderkey", "size", "digest", "folder-v1")


@query("""
    WITH s AS (SELECT p_partkey, p_name, p_type, count(l_partkey) AS n, coalesce(max(l_quantity), 0) AS top, coalesce(bool_or(l_returnflag = 'R'), false) AS returned, count(DISTINCT l_linestatus) AS states
        FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)
    SELECT p_partkey, CASE WHEN n = 0 THEN 'held' WHEN states > 1 AND top >= 50 THEN 'held' WHEN p_type = 'PROMO' THEN 'excluded' WHEN returned THEN 'held' WHEN contains(p_name, 'ring') THEN 'accepted' ELSE 'excluded' END AS decision,
        CASE WHEN n = 0 THEN 'missing' WHEN states > 1 AND top >= 50 THEN 'conflict' WHEN p_type = 'PROMO' THEN 'not_supported' WHEN returned THEN 'unsafe' WHEN contains(p_name, 'ring') THEN 'functional' ELSE 'not_functional' END AS kind,
        array_to_string(list_filter([CASE WHEN n > 30 THEN 'many' END, CASE WHEN top >= 50 THEN 'large' END, CASE WHEN returned THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS evidence FROM s""")
def classify_rules(table):
    """Ordered gates over grouped rows: the first that holds decides, with the evidence beside it."""
    lines = table("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_linestatus").alias("states"))
    rows = table("part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gates = [
        rules.Rule(F.col("n") == 0, "held", "missing"),
        rules.Rule((F.col("states") > 1) & (F.col("top") >= 50), "held", "conflict"),
        rules.Rule(F.col("p_type") == "PROMO", "excluded", "not_supported"),
        rules.Rule(F.col("returned"), "held", "unsafe"),
        rules.Rule(text.contains_any(F.col("p_name"), ["ring"]), "accepted", "functional"),
    ]
    codes = rules.evidence({"many": F.col("n") > 30, "large": F.col("top") >= 50, "returned": F.col("returned")})
    decided = rows.withColumn("d", rules.decide(gates, "excluded", "not_functional"))
    return decided.select("p_partkey", "d.decision", "d.kind", F.concat_ws(",", codes).alias("evidence"))


@query("""
    SELECT doc_id, CASE WHEN contains(x, ' dwi') OR contains(x, 'license') THEN 'diffusion' WHEN contains(x, ' asl') THEN 'asl' WHEN contains(x, 'than the') THEN 'functional' WHEN contains(x, ' de la') THEN 'localizer' ELSE 'other' END AS kind
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)""")
def detected_kind(table):
    """Kinds in order of precedence by what texts contain; needles may begin with a space."""
    kinds = [([" dwi", "license"], "diffusion"), ([" asl"], "asl"), (["than the"], "functional"), ([" de la"], "localizer")]
    gates = [rules.Rule(text.contains_any(F.col("text"), needles), kind, kind) for needles, kind in kinds]
    return table("documents").select("doc_id", rules.decide(gates, "other", "other").getField("kind").alias("kind"))


@query("""
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'complete' END, CASE WHEN o_totalprice > 200000 THEN 'large' END,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS evidence FROM orders""")
def evidence_list(table):
    """Evidence codes in order, absent ones left out."""
    codes = {"complete": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return table("orders").select("o_orderkey", F.concat_ws(",", rules.evidence(codes)).alias("evidence"))


def _elements(table):
    """Part rows as elements: (file, depth, name, kind, value)."""
    part = table("part")
    cells = [(0, "name", "LO", "p_name"), (0, "brand", "SH", "p_brand"), (1, "type", "CS", "p_type"), (1, "size", "DS", "p_size"), (2, "made", "DA", "p_partkey"), (2, "price", "DS", "p_retailprice")]
    rows = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for d, n, k, c in cells])
    return part.select(F.col("p_partkey").alias("file"), F.explode(rows).alias("e")).select("file", "e.*")


_ELEMENTS_SQL = """e AS (SELECT p_partkey AS file, 0 AS depth, 'name' AS name, 'LO' AS kind, p_name AS value FROM part
        UNION ALL SELECT p_partkey, 0, 'brand', 'SH', p_brand FROM part UNION ALL SELECT p_partkey, 1, 'type', 'CS', p_type FROM part
        UNION ALL SELECT p_partkey, 1, 'size', 'DS', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 2, 'made', 'DA', CAST(p_partkey AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 2, 'price', 'DS', CAST(p_retailprice AS VARCHAR) FROM part)"""


@query(f"""
    WITH {_ELEMENTS_SQL} SELECT file, depth, name, kind, CASE kind WHEN 'CS' THEN upper(value) WHEN 'LO' THEN upper(trim(value)) ELSE value END AS value
    FROM e WHERE (name, kind) IN (('name', 'LO'), ('type', 'CS'), ('size', 'DS'), ('made', 'DA')) AND kind NOT IN ('DA', 'DT', 'TM')""")
def allowlist_project(table):
    """Default-deny projection of nested elements: only allowed (name, kind) pairs, no dates, values canonical."""
    from gneiss.operators.redact import project

    return project(_elements(table), [("name", "LO"), ("type", "CS"), ("size", "DS"), ("made", "DA")])


@query(f"""
    WITH {_ELEMENTS_SQL}, p AS (SELECT kind, CASE kind WHEN 'CS' THEN upper(value) WHEN 'LO' THEN upper(trim(value)) ELSE value END AS value
        FROM e WHERE (name, kind) IN (('name', 'LO'), ('type', 'CS'), ('size', 'DS')))
    SELECT count(*) AS elements, CAST(coalesce(sum(CASE WHEN kind IN ('CS', 'LO') AND value <> upper(trim(value)) THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM p""")
def audit_fixpoint(table):
    """The audit of a projection: values that are not their own canonical form (none)."""
    from gneiss.operators.redact import audit, project

    allowed = [("name", "LO"), ("type", "CS"), ("size", "DS")]
    return audit(project(_elements(table), allowed), allowed)


@query(f"""
    WITH {_ELEMENTS_SQL} SELECT file, max(depth) AS depth, max(depth) > 32 OR bool_or(name = 'made') AS flagged, count(*) <= 100000 AS within_items FROM e GROUP BY 1""")
def recursive_depth(table):
    """Whether an element lies at any depth of a file, with caps that fail closed."""
    return _elements(table).groupBy("file").agg(F.max("depth").alias("depth"), ((F.max("depth") > 32) | F.bool_or(F.col("name") == "made")).alias("flagged"), (F.count("*") <= 100_000).alias("within_items"))


@query("""
    WITH t AS (SELECT vec_id, list_transform(generate_series(0, 9), lambda i: embedding[3 * i + 1:3 * i + 3]) AS a, list_transform(generate_series(10, 19), lambda i: embedding[3 * i + 1:3 * i + 3]) AS b FROM embeddings)
    SELECT vec_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x[1]::DOUBLE - y[1]::DOUBLE) <= 0.05 AND abs(x[2]::DOUBLE - y[2]::DOUBLE) <= 0.05 AND abs(x[3]::DOUBLE - y[3]::DOUBLE) <= 0.05)) = 0)) = 0
        AND len(list_filter(b, lambda y: len(list_filter(a, lambda x: abs(x[1]::DOUBLE - y[1]::DOUBLE) <= 0.05 AND abs(x[2]::DOUBLE - y[2]::DOUBLE) <= 0.05 AND abs(x[3]::DOUBLE - y[3]::DOUBLE) <= 0.05)) = 0)) = 0 AS agree,
        list_count(list_filter(a, lambda x: x[1]::DOUBLE * x[1]::DOUBLE + x[2]::DOUBLE * x[2]::DOUBLE + x[3]::DOUBLE * x[3]::DOUBLE BETWEEN 0.5 AND 1.5)) AS unit_vectors FROM t""")
def tensor_agree(table):
    """Mutual match of two sets of triples within a tolerance, and how many are unit vectors."""
    slices = lambda i: F.expr(f"transform(sequence({i}, {i + 9}), i -> transform(slice(embedding, 3 * i + 1, 3), x -> cast(x as double)))")
    close = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: F.abs(p - q) <= 0.05), lambda z: z)
    rows = table("embeddings").select("vec_id", slices(0).alias("a"), slices(10).alias("b"))
    units = F.size(F.filter("a", numbers.is_unit_vector)).cast("long")
    return rows.select("vec_id", grouping.any_all_agree(F.col("a"), F.col("b"), close).alias("agree"), units.alias("unit_vectors"))


@query("""
    SELECT event_id, greatest(250 * CAST(pow(2, event_id % 5) AS BIGINT), least(CAST(value * 1000 AS BIGINT), 30000)) AS delay_ms, strftime(make_timestamp(1000000 * (1700000000 + event_id)), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM events""")
def retry_times(table):
    """Back-off delays and ISO times from epoch seconds."""
    asked = F.round(F.col("value") * 1000).cast("long")
    at = numbers.iso_time(F.col("event_id") + 1_700_000_000)
    return table("events").select("event_id", numbers.retry_delay_ms((F.col("event_id") % 5).cast("int"), asked).alias("delay_ms"), at.alias("at"))
