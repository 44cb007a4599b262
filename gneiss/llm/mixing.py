"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import SMALL, count_words, fresh, split_join, staged

#: Slots of the schedule, about; blocks a source is cut into, at least; shuffle buckets of each source; sources ranked in one sorted part.
SLOTS, LEAST_BLOCKS, BUCKETS, PART = 1 << 18, 256, 1024, 100_000
#: The golden ratio's fraction times 2**62, made odd: k * PHI mod 2**62 visits the unit interval evenly.
ONE = 1 << 62
PHI = 2850178113940765825


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """Sources with `rank` (from 0, in order of key) and `part`; counted in sorted parts, so no list of all keys is needed."""
    spark = sources.sparkSession
    n = sources.count()
    parts = sources.repartitionByRange(max(1, -(-n // PART)), key).sortWithinPartitions(key)
    placed = staged(parts.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sources")
    before, first = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):
        before.append((r["part"], first))
        first += r["count"]
    offsets = spark.createDataFrame(before, "part int, first long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("first") + F.col("place")).drop("first", "place")


def shares(sources: DataFrame, total: int, limit: float = 3.0) -> DataFrame:
    """Sources (s, w) with `target`: a share of total by weight w, at most `limit` times the size s.

    The excess of capped sources is shared again by weight until no source is above its cap; each round is one aggregation.
    """
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("w") * F.lit(level) > limit * F.col("s")
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("s")).otherwise(0)).alias("s"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            return sources.withColumn("target", F.when(over, limit * F.col("s")).otherwise(F.col("w") * F.lit(level or 0.0)))
        capped, level = r["n"], (total - limit * (r["s"] or 0)) / r["w"]


def schedule(spark, plan: DataFrame, slots: int, sources: int) -> DataFrame:
    """(sid, blocks, rank, slot): slot k goes to the source whose cumulative weights hold the k-th golden-ratio point.

    plan: sid, low, high (bounds of 0 to ONE), quota and blocks. Ranks count a source's slots in order;
    those beyond its quota are void, and what a source lacks (a few, by the points' even spread) is appended.
    Sources are found by an equi-join on cells of the unit interval, several for each source.
    """
    cells = 1 << max(12, (4 * sources).bit_length())
    point = F.expr(f"cast(pmod(cast(id as decimal(18, 0)) * cast({PHI} as decimal(19, 0)), cast({ONE} as decimal(19, 0))) as bigint)")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.expr(f"x div {ONE // cells}"))
    spans = plan.filter("high > low").withColumn("cell", F.explode(F.expr(f"sequence(low div {ONE // cells}, (high - 1) div {ONE // cells})")))
    drawn = points.join(F.broadcast(spans) if sources <= SMALL else spans, "cell").filter("x >= low and x < high").select("sid", "quota", "blocks", "slot")
    numbered = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1)
    numbered = staged(numbered.filter("rank < quota").select("sid", "blocks", F.col("rank").cast("long").alias("rank"), "slot"), "slots")
    have = numbered.groupBy("sid").agg(F.count("*").alias("n"))
    lacking = plan.join(have, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < quota")
    extra = lacking.select("sid", "blocks", F.explode(F.expr("sequence(n, quota - 1)")).alias("rank")).withColumn("slot", F.lit(slots) + F.xxhash64("sid", "rank").bitwiseAND(0xFFFF))
    return numbered.unionByName(extra)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = 3.0, weights=(1, 2, 3), seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs.

    Size is the number of words; null texts have none. Sources in order of code point, null last, weigh
    as `weights` repeats; targets are those of `shares`. Each source's documents are shuffled by a hash of their id
    and cut into equal-token blocks; the schedule's slots walk through a source's blocks in order, again
    from the first after the last, `limit` times at most. taken is the number of a document's words in the blocks
    of all its source's slots. Wordless documents are taken 0 times; an empty table gives no rows; rows that
    repeat an id count each. The same input gives the same mix. There may be any number of sources: they are ranked, capped and
    joined in Spark, and only where they are few is their table broadcast.
    """
    spark = docs.sparkSession
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("m"), source_col))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), count_words(F.col(text_col)).alias("size"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id"))).withColumn("_bucket", F.expr(f"pmod(_h, {BUCKETS})"))
    rows = staged(rows, "sizes")
    # null sorts last: "m..." keys come before the key "n"
    found = ranked(rows.groupBy("_key").agg(F.sum("size").alias("s"), F.count("*").alias("n")), "_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    found = found.withColumn("w", weight)
    sums = found.agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.sum("n").alias("rows")).first()
    total, sources = sums["s"] or 0, sums["n"]
    # 256 blocks at least, fewer only beyond millions of sources
    least = max(16, min(LEAST_BLOCKS, (1 << 30) // max(1, sources)))
    each = max(1.0, total / SLOTS)
    plan = shares(found, total, limit)
    plan = plan.withColumn("blocks", F.least("s", F.greatest(F.lit(least), F.round(F.col("s") / each).cast("long"))))
    quota = F.least(F.floor(limit * F.col("blocks")), F.round(F.col("target") * F.col("blocks") / F.col("s")).cast("long"))
    plan = plan.withColumn("quota", F.when(F.col("s") > 0, quota).otherwise(0))
    # a little more than the quota, so that few slots need appending
    plan = staged(plan.withColumn("reach", F.when(F.col("quota") > 0, F.col("quota") + 8 + F.expr("quota div 1000")).otherwise(0)), "plan")
    before, reach = [], 0
    for r in sorted(plan.groupBy("part").agg(F.sum("reach").alias("reach")).collect()):
        before.append((r["part"], reach))
        reach += r["reach"]
    offsets = spark.createDataFrame(before, "part int, first long")
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.join(F.broadcast(offsets), "part").withColumn("end", F.col("first") + F.sum("reach").over(inside))
    bound = f"cast(cast({{}} as decimal(18, 0)) * cast({ONE} as decimal(19, 0)) div {max(1, reach)} as bigint)"
    plan = plan.withColumn("low", F.expr(bound.format("end - reach"))).withColumn("high", F.expr(bound.format("end")))
    plan = plan.select(F.col("rank").alias("sid"), "_key", F.col("s").alias("source_size"), "n", "target", "blocks", "quota", "low", "high")
    slots = schedule(spark, plan.select("sid", "low", "high", "quota", "blocks"), max(1, reach), sources)
    uses = slots.groupBy("sid", F.expr("rank % blocks").alias("block")).agg(F.count("*").alias("uses"))

    named = plan.select("_key", "sid", "source_size", "target", "blocks", "n")
    if sources <= SMALL:
        named = rows.join(F.broadcast(named), "_key").drop("_key", "n")
    else:
        named = split_join(rows, named, "_key", "n", sums["rows"], F.col("_h")).drop("_key", "n")
    # places in the source's shuffled stream: sums of buckets, then running sums inside each
    inside = Window.partitionBy("sid", "_bucket").orderBy("_h", "_id", "size")
    before = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy("sid", "_bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = named.withColumn("_n", F.row_number().over(inside)).withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, ["sid", "_bucket"]).withColumn("_start", F.col("base") + F.col("_end") - F.col("size"))
    # block b holds the words from ceil(b * source_size / blocks) on; word w lies in block w * blocks div source_size
    wide = "cast({} as decimal(20, 0)) * cast({} as decimal(12, 0))"
    first, last = (f"{wide.format(w, 'blocks')} div source_size" for w in ("_start", "_start + size - 1"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"if(size = 0, array(-1L), sequence({first}, {last}))")))
    edge = lambda b: f"(({wide.format('source_size', b)} + blocks - 1) div blocks)"
    words = f"if(size = 0, 0L, least({edge('block + 1')}, _start + size) - greatest({edge('block')}, _start))"
    joined = pieces.withColumn("words", F.expr(words)).join(uses, ["sid", "block"], "left")
    keys = ["_id", "sid", "_bucket", "_n", "size", "source_size", "target"]
    summed = joined.groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    return summed.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it (to the nearest whole number).

    Only the documents at a source's last block edge are taken in part, so whole copies keep each
    source within about half a document of what `mix` takes. Wordless documents, which no mix takes, go; null ids stay once.
    """
    id_, n, copy = (fresh(docs, x) for x in ("_taken_id", "_copies", "_copy"))
    # the copies of an id are averaged over the rows that repeat it
    taken = mix(docs, id_col, text_col, **how).filter((F.col("size") > 0) & F.col(id_col).isNotNull())
    copies = taken.groupBy(F.col(id_col).alias(id_)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(n)).filter(F.col(n) > 0)
    kept = docs.join(copies, docs[id_col] == F.col(id_), "left").withColumn(n, F.when(docs[id_col].isNull(), 1).otherwise(F.col(n)))
    return kept.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
