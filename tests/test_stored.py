"""Queries over written files whose element rows were stored in full before they were judged."""

from __future__ import annotations

import pytest

from gneiss.plans import units  # noqa: F401
from gneiss.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["macro_audit", "rebuilt_items"])
def test_element_rows_are_not_stored_and_meet_once_before_and_once_after_writing(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD[file" not in plan
    assert plan.count("Exchange hashpartitioning(file") == 2
