"""Aggregations of instances into series whose results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANY = (1 << 63) - 1


def isolated(key: Column, path: Column) -> Column:
    """The grouping key; a row without one is a group of its own, named by its path."""
    return F.when(key.isNull() | (key == ""), F.concat(F.lit("missing:"), path)).otherwise(key)


def representative(row: Column, number: Column, path: Column) -> Column:
    """The group's row of the lowest number (null last), then path."""
    return F.min_by(row, F.struct(F.coalesce(number.cast("long"), F.lit(MANY)), path))


def first_known(value: Column, number: Column, path: Column) -> Column:
    """The representative's value, or the first known one in the same order."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(F.coalesce(number.cast("long"), F.lit(MANY)), path)))


def bounded_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int, overflow: str) -> DataFrame:
    """(key, values): each key's distinct values in order of first sight, `limit` at most, then the overflow mark.

    Distinct values are found by aggregation; only limit + 1 of them reach a group's array, whatever its size.
    """
    seen = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_first", value))
    few = seen.withColumn("_rank", rank).filter(F.col("_rank") <= limit + 1)
    pairs = F.array_sort(F.collect_list(F.struct("_rank", F.when(F.col("_rank") <= limit, F.col(value).cast("string")).otherwise(overflow).alias("v"))))
    return few.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def conflict(value: Column, strict: bool = False) -> Column:
    """Whether a group has two values; strict: being missing is a value too."""
    return F.count_distinct(F.coalesce(value.cast("string"), F.lit("\0")) if strict else value) > 1


def safe_value(canonical: Column, value: Column) -> Column:
    """The one canonical value of a group: all rows have a value, every one is canonical, and all agree."""
    return F.when((F.count("*") == F.count(canonical)) & (F.count(value) == F.count("*")) & (F.count_distinct(canonical) == 1), F.min(canonical))


def repeated(position: Column, n: Column) -> Column:
    """Whether all rows have a position and positions repeat at least twice on average."""
    return (F.count(position) == n) & (F.floor(n / F.greatest(F.lit(1), F.count_distinct(position))) >= 2)


def staging_need(size: Column) -> Column:
    """Bytes to stage a series: all files, the largest one twice more, and 64 MiB."""
    return F.sum(size) + 2 * F.max(size) + 67_108_864


def complete(number: Column, expected: Column) -> Column:
    """Whether a group's numbers are exactly 1 to expected."""
    return (F.count(number) == expected) & (F.min(number) == 1) & (F.max(number) == expected) & (F.count_distinct(number) == expected)


def fingerprint(rows: DataFrame, key: str, path: str, size: str, digest: str, tag: str) -> DataFrame:
    """(key, fingerprint): SHA-256 over the tag, the file count, and path, size and digest of each file in path order."""
    line = F.concat_ws("|", F.col(path).cast("string"), F.col(size).cast("string"), F.col(digest))
    files = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("line"))))
    text = F.concat_ws("\n", F.lit(tag), F.count("*").cast("string"), F.transform(files, lambda f: f["line"]))
    return rows.groupBy(key).agg(F.sha2(text, 256).alias("fingerprint"))


def any_all_agree(left: Column, right: Column, agree) -> Column:
    """Mutual match of two arrays: each element of one agrees with some element of the other."""
    one = F.forall(left, lambda a: F.exists(right, lambda b: agree(a, b)))
    return one & F.forall(right, lambda b: F.exists(left, lambda a: agree(a, b)))


def dealt(rows: DataFrame, key: str, n_rows: int, most: int = 500_000) -> DataFrame:
    """The rows, shuffled by key into tasks of about `most` of `n_rows` rows where the session's partitions would be larger, so that a task's sort does not grow with the table."""
    n = -(-n_rows // most)
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
