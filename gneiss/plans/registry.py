"""Registry of catalogue queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (table) -> DataFrame under its name; `table` reads a table of the data folder."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # HotSpot interprets methods over this size and never compiles them; stages with larger ones run operator by operator, in small methods
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        if build.__name__ in QUERIES:
            raise ValueError(f"{build.__name__} is registered twice")
        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql
        return build

    return register
