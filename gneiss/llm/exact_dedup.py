"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare texts inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import WS, split_join, staged, without

#: Bits of the filter for texts to compare: 16 MB of bitmaps at most, whatever the table's size.
FILTER_BITS = 27


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def hash128(sha256: Column) -> Column:
    return F.unhex(F.substring(sha256, 1, 32))


def repeated_marks(marks: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the column `mark` (1 to 2**FILTER_BITS), of 2**(FILTER_BITS - 15) rows of 4 KiB at most."""
    return marks.groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))


def is_marked(bits: Column, mark: Column) -> Column:
    """Whether the bit of the mark is set in its bucket's bitmap."""
    place = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substr(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.pmod(byte / F.pow(F.lit(2), place % 8), F.lit(2)) >= 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=hash128) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when their normalised bytes are; null is the empty text. The smallest id of equal
    texts stays; null ids lose to others and stay only where a group has no other id. Rows that repeat
    an id are the same document and share its fate. An empty table gives no rows; other columns are
    not read, so their names cannot clash.

    `key` makes the 128-bit content hash from the text's SHA-256. Hashes and ids alone are grouped first. Only texts
    whose hash occurs twice or more are then compared byte by byte, in one aggregation by (hash, text) that collapses
    copies before its shuffle; a broadcast bitmap of fixed size finds them (the few others that share its bits are
    compared too). A hash with two texts is a collision: its rows alone are matched by hash and text.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.pmod(F.xxhash64(raw), F.lit(1 << FILTER_BITS)) + 1
    sha = F.sha2(normalised(F.col(text_col)), 256)
    rows = docs.select(F.col(id_col).alias("_id"), sha.alias("_sha"), mark.alias("mark")).withColumn("_key", key(F.col("_sha")))
    rows = staged(rows, "exact-hashes")
    groups = rows.groupBy("_key").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = staged(split_join(rows, groups, "_key", "group_size", rows.count(), F.col("_id")), "exact-groups")
    out = ["_id", "keep_id", "group_size", "_sha"]

    marks = repeated_marks(found.filter("group_size > 1").select("mark"))
    again = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), mark.alias("mark"))
    again = again.withColumn("bucket", F.bitmap_bucket_number("mark")).join(F.broadcast(marks), "bucket").filter(is_marked(F.col("bits"), F.col("mark")))
    texts = again.select("_id", normalised(F.col("_text")).alias("_text")).withColumn("_sha", F.sha2("_text", 256)).withColumn("_key", key(F.col("_sha")))
    variants = texts.groupBy("_key", "_text").agg(F.lit(1).alias("one"))
    collided = staged(variants.groupBy("_key").agg(F.count("*").alias("texts")).filter("texts > 1").select("_key"), "collisions")
    if collided.isEmpty():
        result = found.select(*out)
    else:
        mixed = texts.join(collided, "_key", "left_semi")
        exact = mixed.groupBy("_key", "_text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        result = found.join(collided, "_key", "left_anti").select(*out).union(mixed.join(exact, ["_key", "_text"]).select(*out))
    return result.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they were; null ids stay."""
    return without(docs, exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(id_col), id_col)
