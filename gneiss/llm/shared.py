"""What several training-data operators share: staged tables, skew-proof joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"
#: A frame of at most this many rows is broadcast, after its rows are counted; a larger one is shuffled.
SMALL = 20_000
#: At most this many keys can each hold over 1/HOT of all rows, so a table of them can be broadcast at any size.
HOT = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a temporary one.

    On a cluster a machine's own folder would not do, so there the setting is required.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gneiss-"))
        folder = context.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    This cuts the lineage and survives lost executors; each call gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gneiss/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove the files of a staged frame that nothing will read again."""
    spark = frame.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(frame: DataFrame, name: str) -> str:
    """The name, with underscores added until the frame has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in lost's one column; null ids stay."""
    name = fresh(docs, "_lost")
    return docs.join(lost.toDF(name), docs[id_col] == F.col(name), "left_anti")


def hash_sample(frame: DataFrame, keys: list[str], rows: int, total: int, seed: int = 1) -> DataFrame:
    """About `rows` of the frame's `total` rows (all, if it has fewer), chosen by a hash of keys: the same ones each time."""
    share = min(1.0, rows / max(1, total))
    return frame.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def count_words(text: Column) -> Column:
    """Number of white-space separated words; null counts as empty."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WS, "x")
    return F.length(F.regexp_replace(marks, WS, "")).cast("long")


def split_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows to groups, one group row for each value of key, safe for hot keys.

    Groups that hold over total / HOT rows (so at most HOT of them) are broadcast; the rows of all
    others are shuffled by key. Rows of hot keys are dealt out by `spread`, never by their key.
    `size` names the groups' row count; the result has rows' columns, then groups' without key.
    """
    values = [c for c in groups.columns if c != key]
    limit = max(1000, total // HOT)
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) <= limit).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"), F.lit(0).alias("_cold_spread"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
    is_hot = F.col("_hot_key").isNotNull()
    marked = marked.withColumn("_spread", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0).cast("int"))
    joined = marked.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    return joined.select(*rows.columns, *[F.when(is_hot, F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    `edges` has long columns a and b. Alternating large-star and small-star rounds, each staged in the
    shared folder, until nothing changes; nodes without edges do not appear. Every round
    takes minima with map-side aggregation, and hubs are joined by split_join.
    """
    spark = edges.sparkSession
    current = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        n = current.count()
        if n == 0:
            return spark.createDataFrame([], "node long, root long")
        # large star: the larger neighbours of u go to the smallest node near u
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("near"))
        large = split_join(both, least, "u", "near", 2 * n, F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours go to the smallest of them
        large = staged(large.filter("u <> v").distinct(), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("near"))
        small = split_join(large, down, "u", "near", max(1, large.count()), F.col("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        last, current = current, staged(small.filter("u <> v").distinct(), "small-star")
        discard(last)
        discard(large)
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(after):
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(after)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
