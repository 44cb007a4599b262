"""Groups of rows that lie together, against Spark's own grouping, and the query that stored all rows before."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators.together import grouped
from gneiss.plans import units  # noqa: F401
from gneiss.plans.registry import QUERIES


def test_files_are_grouped_where_they_lie_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        rows = spark.range(0, 54_000, 1, 3).selectExpr("id div 60 as file", "case when id % 60 < 40 then 'a' else 'b' end as part", "cast(id % 7 as string) as key", "cast(id % 11 as int) as n", "if(id % 3 = 0, null, cast(id as string)) as text")
        found = {"least": ("n", "min"), "sum": ("n", "sum"), "most": ("text", "max")}
        one, other = (grouped(rows, ["file", "part", "key"], found, t) for t in (True, False))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
        # groups of groups: a file's still follow each other
        again = {"n": ("sum", "sum"), "most": ("most", "max")}
        assert sorted(map(repr, grouped(one, ["file"], again, True).collect())) == sorted(map(repr, grouped(other, ["file"], again, False).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_surface_checks_store_and_shuffle_no_element_rows(spark):
    plan = QUERIES["surface_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD[file" not in plan
    assert "Exchange" not in plan[: plan.rindex("MapInArrow")]  # the last one listed, the first to run, is the parser
