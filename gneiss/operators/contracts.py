"""Contracts over elements and instances: bounds, child sets, shared-or-all coverage, one vendor, declared counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bounds(rows: DataFrame, name: str, value: str, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """Rows with `in_bounds` by a table of (name, least, most); names without bounds are out."""
    table = rows.sparkSession.createDataFrame(bounds, "_name string, _least double, _most double")
    joined = rows.join(F.broadcast(table), F.col(name) == F.col("_name"), "left")
    fine = F.col(value).cast("double").between(F.col("_least"), F.col("_most"))
    return joined.withColumn("in_bounds", F.coalesce(fine, F.lit(False))).drop("_name", "_least", "_most")


def has_exactly(child: Column, wanted: list[str]) -> Column:
    """Whether a group's children are these and no others, each at least once; sets only, so groups stay small."""
    return F.array_sort(F.collect_set(child)) == F.array(*map(F.lit, sorted(wanted)))


def shared_or_all(shared: Column, frames: Column, expected: Column) -> Column:
    """Whether a macro is given once for all frames or once in every frame, never both or some."""
    return ((shared == 1) & (frames == 0)) | ((shared == 0) & (frames == expected))


def exactly_one(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(f, F.lit(False)).cast("int")
    return total == 1


def declared(parents: DataFrame, key: str, count: str, children: DataFrame, child_key: str) -> DataFrame:
    """Parents with `found` children and whether that is what they declare."""
    found = children.groupBy(F.col(child_key).alias("_child")).agg(F.count("*").alias("_n"))
    joined = parents.join(found, F.col(key) == F.col("_child"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return joined.withColumn("found", n).withColumn("as_declared", n == F.col(count)).drop("_child", "_n")
