"""Default-deny projection of nested elements and the audit that proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that hold dates and times, which are never kept.
DATED = ("DA", "DT", "TM")


def canonical(kind: Column, value: Column) -> Column:
    """The value in the form its kind allows."""
    return F.when(kind == "CS", F.upper(F.trim(value))).when(kind == "LO", F.upper(F.trim(value))).otherwise(value)


def project(elements: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Elements (file, depth, name, kind, value) whose (name, kind) is allowed at any depth, with canonical values."""
    spark = elements.sparkSession
    allow = spark.createDataFrame(allowed, "name string, kind string")
    kept = elements.filter(~F.col("kind").isin(*DATED)).join(F.broadcast(allow), ["name", "kind"], "left_semi")
    return kept.select("file", "depth", "name", "kind", canonical(F.col("kind"), F.col("value")).alias("value"))


def audit(elements: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """(elements, violations): what is not allowed, dated, or not its own canonical form; clean output has none."""
    listed = F.lit(False)
    for name, kind in allowed:
        listed = listed | ((F.col("name") == name) & (F.col("kind") == kind))
    fine = listed & ~F.col("kind").isin(*DATED) & F.col("value").eqNullSafe(canonical(F.col("kind"), F.col("value")))
    return elements.agg(F.count("*").alias("elements"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("violations"))
