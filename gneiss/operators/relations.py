"""Joins, set comparisons and listings of the catalog side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_without_later(rows: DataFrame, finished: DataFrame, key: str, time: str) -> DataFrame:
    """Rows with no later finished row of the same key.

    The theta anti join needs only each key's last finish, so it is an aggregate and an equi-join.
    """
    last = finished.groupBy(key).agg(F.max(time).alias("_last"))
    return rows.join(last, key, "left").filter(F.col("_last").isNull() | (F.col("_last") <= F.col(time))).drop("_last")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, state): added, missing, changed or same between two snapshots with unique keys."""
    b = before.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compare])
    a = after.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}"))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "missing").when(same, "same").otherwise("changed")
    return b.join(a, F.col("_b") == F.col("_a"), "full").select(F.coalesce("_b", "_a").alias(key), state.alias("state"))


def reconcile(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, asked, found): how often each key occurs on both sides; total and exact where both are 1."""
    counts = asked.select(key, F.lit(1).alias("a"), F.lit(0).alias("f")).union(found.select(key, F.lit(0).alias("a"), F.lit(1).alias("f")))
    return counts.groupBy(key).agg(F.sum("a").alias("asked"), F.sum("f").alias("found"))


def publication(scheduled: Column, now: Column) -> Column:
    """Null without a schedule, else staged before it and published from it on; now is bound by the caller."""
    return F.when(scheduled.isNull(), F.lit(None).cast("string")).when(scheduled <= now, "published").otherwise("staged")


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """A listing of the first rows; the order must be total for equal results."""
    return rows.orderBy(*order).limit(limit)
