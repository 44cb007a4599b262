"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds choose what is added.

Everything that touches texts is DataFrame expressions. Patterns are written so that no text costs more than linear time: a match
starts only where a run of its first characters starts, and what repeats is possessive. Labels for the trees come from the
corpus itself and from SEEDS: spans of the base patterns that pass their checks are personal data, those that fail are not; other
proposals count as not, unless they overlap a base span of their kind or a cue word stands before them (then they teach nothing).
The trees see small whole numbers only (format and context), so counts by distinct feature vectors, over all rows, are all that training needs.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import staged

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns by kind: matches are those of the plain patterns, leftmost and not overlapping.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of high recall: written-out addresses, other separators, six-part and guarded numbers, numbers without a plus.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:@|[(\[{] ?at ?[)\]}]|(?<= )at ) ?[a-z0-9-]++(?: ?(?:\.|[(\[{] ?dot ?[)\]}]|(?<= )dot ) ?[a-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ ./_\xa0-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\+|00)?[ ]?\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9A-Za-z])",
}
#: Words that announce a kind, within CONTEXT characters before a span.
CUES = {
    "email": r"e-?mail|mail|contact|write|reach",
    "ip": r"\bip\b|ipv[46]|host|server|client|login",
    "card": r"card|visa|mastercard|amex|credit|payment|paid",
    "phone": r"phone|\btel\b|telephone|call|mobile|\bcell\b|fax|whatsapp|dial|text me",
}
CONTEXT = 32
#: Labelled statements: (kind, whether proposals of that kind in it are personal data, text); of other kinds they are not.
SEEDS = [
    ("phone", 1, "please call 555 201 7733 today"), ("phone", 1, "phone: (030) 555-1290, weekdays"), ("phone", 1, "mobile 0171 555 2281"), ("phone", 1, "tel. 020.5550.1199"),
    ("phone", 1, "dial 0049 30 555 8812 now"), ("phone", 1, "her cell is 415-555-0117."), ("phone", 1, "fax (212) 555 0143"), ("phone", 1, "text me at 617.555.0102"),
    ("phone", 0, "pages 120-134 and 200-210"), ("phone", 0, "on 2021-04-17 it rained"), ("phone", 0, "between 10 20 and 30 45"), ("phone", 0, "score 21-14 15-21 11-15"),
    ("phone", 0, "item 44/120 of 12/2019"), ("phone", 0, "at 12.30 or 14.45"),
    ("email", 1, "mail jo.lee at example dot org"), ("email", 1, "contact: ana [at] example [dot] com"), ("email", 1, "e-mail sam(at)example.net please"), ("email", 1, "write to kim @ example.com"),
    ("email", 1, "reach bea at sample dot net"), ("email", 1, "contact max at example dot com"),
    ("email", 0, "look at the dot here"), ("email", 0, "we met at noon dot to dot"), ("email", 0, "version 2 @ 1.5 scale"),
    ("ip", 1, "server 10[.]20[.]30[.]40 answered"), ("ip", 1, "host fe80:0:0:1:22:33:44:55 is up"), ("ip", 1, "login from 2001:db8:0:11:22:33:44:55"), ("ip", 1, "client 192(.)168(.)7(.)9"),
    ("ip", 0, "the race took 1:02:33 in all"), ("ip", 0, "from 10:20:30 to 11:00:00"), ("ip", 0, "ratio 3:4:5"),
    ("card", 1, "card 4111.1111.1111.1111 was used"), ("card", 1, "paid with visa 4012/8888/8888/1881"), ("card", 1, "credit card: 5555_5555_5555_4444"), ("card", 1, "amex 3782.822463.10005"),
    ("card", 0, "serial 1234.5678.9012.3456"), ("card", 0, "part 0001/0002/0003/0005"), ("card", 0, "on 2019.01.02 2020.03.04"),
]
#: All seeds together weigh this share of the corpus' labelled spans, and each counts as one at least.
SEED_SHARE = 0.05
#: Calibrated probability from which a proposal is added; rounds, depth and step of boosting; every CALIBRATE-th document calibrates.
LEAST, ROUNDS, DEPTH, RATE, CALIBRATE = 0.9, 30, 3, 0.3, 5
FEATURES = ["kind", "digits", "lead", "seps", "shape", "valid", "prev", "next", "cue"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check; false for longer and empty ones."""
    size = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda s, i: s + F.when((size - i) % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return F.when((size >= 1) & (size <= 19), total % 10 == 0).otherwise(False)


def passes(kind: Column, text: Column) -> Column:
    """The base check of a match of its kind."""
    digits = digits_of(text)
    parts = F.split(F.regexp_replace(text, r"[\[\]()]", ""), r"\.")
    number = lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0))
    octets = text.rlike(r"^[0-9.\[\]()]+$") & ~F.exists(parts, lambda p: number(p) > 255)
    return (
        F.when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "ip", octets | text.rlike(r"^[0-9A-Fa-f]{1,4}(::?[0-9A-Fa-f]{1,4}){4,7}$"))
        .otherwise(True)
    )


def proposals(docs: DataFrame) -> DataFrame:
    """(row, id, pattern, kind, base, start, end, match, before, after) of (row, id, text); a row without proposals gives one of nulls.

    `before` and `after` are the characters around a match. Pieces between matches give its place.
    """
    parts, digit = [], F.col("text").rlike("[0-9]")
    asks = {("email", True): F.col("text").contains("@"), ("email", False): F.col("text").rlike("(?i)@|[ (\\[{]at[ )\\]}]")}
    names = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind, pattern in patterns.items():
            name, ask = f"{kind}_{'base' if base else 'loose'}", asks.get((kind, base), digit)
            names.append((name, kind, base))
            parts += [F.when(ask, F.split("text", pattern, -1)).alias(f"{name}_parts"), F.when(ask, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"{name}_found")]
    cut = docs.select("row", "id", *parts)

    def zipped(name: str) -> Column:
        pieces, found = F.col(f"{name}_parts"), F.col(f"{name}_found")
        return F.when(F.size(found) > 0, F.arrays_zip(found.alias("match"), pieces.alias("piece"), F.slice(pieces, 2, F.size(pieces)).alias("next")))

    sides = [F.struct(F.lit(n).alias("pattern"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), zipped(name).alias("spans")) for n, (name, kind, base) in enumerate(names)]
    some = cut.select("row", "id", F.explode_outer(F.filter(F.array(*sides), lambda s: s.spans.isNotNull())).alias("p"))
    spans = some.select("row", "id", "p.pattern", "p.kind", "p.base", F.posexplode_outer("p.spans").alias("pos", "s")).filter("s is null or s.match is not null")
    # the match, what lies between, and the neighbouring characters: a piece as long as a text goes no further
    return spans.select(
        "row", "id", "pattern", "kind", "base", "pos", F.length("s.piece").alias("gap"), F.col("s.match").alias("match"),
        F.right("s.piece", F.lit(CONTEXT)).alias("before"), F.left("s.next", F.lit(1)).alias("after"),
    )


def placed(spans: DataFrame) -> DataFrame:
    """The spans with start, end, and whether base spans of their own kind or of any overlap them, or a failing base match covers them."""
    size = F.length("match")
    run = Window.partitionBy("row", "pattern").orderBy("pos")
    spans = spans.repartition("row").withColumn("start", (F.sum(F.col("gap") + size).over(run) - size).cast("long")).withColumn("end", F.col("start") + size)
    spans = spans.withColumn("valid", passes(F.col("kind"), F.col("match"))).withColumn("is_base", F.col("base") & F.col("valid"))
    # base spans that start before this one ends, and the farthest of their ends
    order = [F.when(F.col("base"), F.col("start")).otherwise(F.col("end") - 1), F.when(F.col("base"), 0).otherwise(1)]
    own, all_ = Window.partitionBy("row", "kind").orderBy(*order), Window.partitionBy("row").orderBy(*order)
    over = lambda when, w: F.coalesce(F.max(F.when(when, F.col("end"))).over(w) > F.col("start"), F.lit(False))
    failed = F.col("base") & ~F.col("valid")
    first = Window.partitionBy("row", "kind").orderBy("start", F.when(F.col("base"), 0).otherwise(1))
    covered = F.coalesce(F.max(F.when(failed, F.col("end"))).over(first) >= F.col("end"), F.lit(False))
    return spans.withColumn("with_own", over(F.col("is_base"), own)).withColumn("with_failed", covered).withColumn("with_any", over(F.col("is_base"), all_))


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of each span as small whole numbers."""
    digits, match = digits_of(F.col("match")), F.col("match")
    n = F.length(digits)
    steps = [1, 7, 9, 12, 13, 16, 17, 20]
    shape = F.regexp_replace(F.regexp_replace(match, "[0-9]", "9"), r"[^0-9A-Za-z]+", "-")
    kind_of = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*$"), 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = F.when(F.col("kind") == kind, F.lower("before").rlike(words)).otherwise(cue)
    found = {
        "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1,
        "f_digits": sum((F.when(n >= s, 1).otherwise(0) for s in steps), F.lit(0)),
        "f_lead": F.when(match.startswith("+"), 0).when(match.startswith("("), 1).when(match.startswith("00"), 2).when(match.rlike("^[0-9]"), 3).otherwise(4),
        "f_seps": F.least(F.lit(2), F.size(F.array_distinct(F.split(F.regexp_replace(match, "[0-9A-Za-z]", ""), "")))),
        "f_shape": F.when(shape.rlike("^9999(-9999)+$"), 1).when(shape.rlike("(^|-)999-9999$"), 2).when(shape.rlike("^9{1,3}(-9{1,3}){3}$"), 3).when(shape.rlike("^99(99)?-99?-99(99)?$"), 4).otherwise(0),
        "f_valid": F.col("valid").cast("int"),
        "f_prev": kind_of(F.right("before", F.lit(1))),
        "f_next": kind_of(F.col("after")),
        "f_cue": cue.cast("int"),
    }
    return spans.withColumns({k: v.cast("int") for k, v in found.items()})


def label(with_cue: Column) -> Column:
    """1: personal data, 0: not, null: unknown."""
    return F.when(F.col("is_base") | F.col("with_own"), 1).when(F.col("base") | F.col("with_failed") | F.col("with_any"), 0).when(~with_cue, 0)


def grow(rows: list, depth: int):
    """A tree over (features, gradient, curvature): (feature, value, at most it, above it) or a leaf's step."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    for f in range(len(FEATURES)) if depth else ():
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x, gi, hi in rows:
            s = sums[x[f]]
            s[0] += gi
            s[1] += hi
        gl = hl = 0.0
        for v in sorted(sums)[:-1]:
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if hl >= 0.5 and h - hl >= 0.5 and gain > (best[0] if best else 1e-6):
                best = (gain, f, v)
    if best is None:
        return RATE * g / (h + 1)
    _, f, v = best
    return f, v, grow([r for r in rows if r[0][f] <= v], depth - 1), grow([r for r in rows if r[0][f] > v], depth - 1)


def value(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(counts: list[tuple[tuple, float, float]]) -> list:
    """Trees of logistic boosting over (features, weight of personal data, weight of others)."""
    scores, trees = [0.0] * len(counts), []
    for _ in range(ROUNDS):
        rows = []
        for (x, yes, no), s in zip(counts, scores):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, yes * (1 - p) - no * p, (yes + no) * p * (1 - p)))
        trees.append(grow(rows, DEPTH))
        scores = [s + value(trees[-1], x) for (x, *_), s in zip(counts, scores)]
    return trees


def threshold(counts: list[tuple[tuple, float, float]], trees: list) -> float:
    """The least score from which the calibrated probability (isotonic over scores) is LEAST or more; infinite if none is."""
    by_score: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, yes, no in counts:
        s = by_score[round(sum(value(t, x) for t in trees), 9)]
        s[0] += yes
        s[1] += no
    pools: list[list[float]] = []  # [least score, personal data, all], their shares rising
    for score in sorted(by_score):
        yes, no = by_score[score]
        pools.append([score, yes, yes + no])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, yes, n = pools.pop()
            pools[-1][1] += yes
            pools[-1][2] += n
    return min((s for s, yes, n in pools if yes >= LEAST * n), default=math.inf)


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, low, high = tree
    return F.when(F.col(f"f_{FEATURES[f]}") <= v, tree_column(low)).otherwise(tree_column(high))


def seeds(spark: SparkSession) -> DataFrame:
    """Labelled proposals of SEEDS."""
    frame = spark.createDataFrame([(i, i, text, kind, wanted) for i, (kind, wanted, text) in enumerate(SEEDS)], "row long, id long, text string, wanted string, personal int")
    found = with_features(placed(proposals(frame.select("row", "id", "text")))).filter("match is not null")
    return found.join(F.broadcast(frame.select("row", "wanted", "personal")), "row").withColumn("label", F.when(F.col("kind") == F.col("wanted"), F.col("personal")).otherwise(0))


def fit(spans: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees, and the threshold of each kind, from all labelled spans, counted by feature vector, and the seeds."""
    by = [f"f_{f}" for f in FEATURES]
    fold = F.crc32(F.col("row").cast("string")) % CALIBRATE == 0
    labelled = spans.filter("match is not null and label is not null").groupBy(*by, fold.alias("held")).agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    counts: dict[bool, list] = {True: [], False: []}
    for r in labelled.collect():  # as many rows as feature vectors there are: 9 small domains
        counts[r["held"]].append((tuple(r[b] for b in by), float(r["yes"]), float(r["no"])))
    taught = sorted((r["row"], tuple(r[b] for b in by), r["label"]) for r in seeds(spans.sparkSession).collect())
    total = sum(yes + no for side in counts.values() for _, yes, no in side)
    weight = max(1.0, SEED_SHARE * total / max(1, len(taught)))
    for _, x, y in taught:
        for side in counts.values():  # few as they are, seeds both teach and calibrate
            side.append((x, weight * y, weight * (1 - y)))
    for side in counts.values():
        side.sort()
    trees = boost(counts[False])
    return trees, {k: threshold([c for c in counts[True] if c[0][0] == k], trees) for k in range(len(KINDS))}


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of docs: spans by kind as listed, then start, each (kind, start, end, base); code points, end exclusive.

    Base spans always stay. A proposal is added if its calibrated score is enough and it overlaps no base span; of added spans those that lie
    within another go. Null counts as empty; empty texts have no spans. Ids may be null or repeat. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # numbered rows are written before they are dealt out, so that a row keeps its number if its task runs again
    spans = staged(proposals(rows), "personal-proposals")
    spans = staged(with_features(placed(spans)).withColumn("label", label(F.col("f_cue") == 1)).drop("before", "after", "gap", "pos", "pattern"), "personal-spans")
    trees, least = fit(spans)
    enough = F.lit(math.inf)
    for k, t in least.items():
        enough = F.when(F.col("f_kind") == k, F.lit(t)).otherwise(enough)
    score = sum((tree_column(t) for t in trees), F.lit(0.0))
    judged = spans.withColumn("score", F.when(F.col("match").isNotNull() & ~F.col("with_any"), F.round(score, 9)))
    judged = judged.withColumn("added", F.coalesce((F.col("score") >= enough) & ~F.col("with_any"), F.lit(False)))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("score"), "f_kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("inside", F.coalesce(F.max(F.when(F.col("added"), F.col("end"))).over(before) >= F.col("end"), F.lit(False)))
    kept = F.when(F.coalesce("is_base", F.lit(False)) | (F.col("added") & ~F.col("inside")), F.struct(F.col("f_kind").alias("k"), "start", "end", F.col("is_base").alias("base")))
    out = judged.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(kept)).alias("spans"))
    named = F.transform("spans", lambda s: F.struct(F.get(F.array(*map(F.lit, KINDS)), s.k).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base")))
    return out.select(F.col("id").alias(id_col), named.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its kind in brackets; of overlapping spans the first by start names the place."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, s: F.concat(a.done, F.substring(text, (a.at + 1).cast("int"), (F.greatest(s.start, a.at) - a.at).cast("int")), F.when(s.end > a.at, F.concat(F.lit("["), s.kind, F.lit("]"))).otherwise(""))
    return F.aggregate(ordered, start, lambda a, s: F.struct(piece(a, s).alias("done"), F.greatest(a.at, s.end).alias("at")), lambda a: F.concat(a.done, F.substring(text, (a.at + 1).cast("int"), F.length(text))))


def personal_digests(docs: DataFrame) -> DataFrame:
    """The contract's row for each document of (doc_id, text)."""
    found = personal_spans(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.base)
    of = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
