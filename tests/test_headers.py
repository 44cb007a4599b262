"""Series from headers: the running representative against a loop, bounded lists, gates that need more than one file."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from gneiss.operators import headers, rules
from gneiss.sources import writer


def by_loop(rows):
    """Whether any file of (instance number, value), in order, is out of tolerance of the running representative."""
    first, drift = None, []
    for at, (number, value) in enumerate(rows):
        key = (math.inf if number is None else number, at)
        if first is None:
            first = [key, value]
            drift.append(False)
            continue
        held = first[1]
        drift.append(held is not None and value is not None and (not math.isfinite(held) or not math.isfinite(value) or abs(held - value) > max(1e-6, max(abs(held), abs(value)) * 1e-6)))
        if key < first[0]:
            first = [key, value if value is not None else held]
        elif first[1] is None:
            first[1] = value
    return drift


def test_running_representative_agrees_with_a_loop(spark):
    rng = random.Random(8)
    series = {s: [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 3.0, 3.0 + 2e-6, 3.0 + 4e-6, 3.1, math.inf, math.nan])) for _ in range(rng.randrange(1, 8))] for s in range(300)}
    rows = [(s, f"{at:03}", float(n) if n is not None else None, v) for s, found in series.items() for at, (n, v) in enumerate(found)]
    frame = spark.createDataFrame(rows, "series long, file string, instance_number double, value double")
    got: dict[int, list] = {}
    for r in headers.with_drift(frame, ("value",)).orderBy("series", "file").collect():
        got.setdefault(r["series"], []).append(r["drift"])
    assert got == {s: by_loop(found) for s, found in series.items()}


def test_lists_are_bounded_in_order_of_first_sight(spark):
    rows = [(1, f"{n:05}", f"c{n % 500}", "MR", None) for n in range(2000)] + [(2, "b", "y", "CT", "NO"), (2, "a", "z", "MR", "NO"), (2, "c", "z", None, None)]
    frame = spark.createDataFrame(rows, "series long, file string, class string, kind string, burned string")
    got = {r["series"]: r for r in headers.bounded_lists(frame, {"classes": "class", "modalities": "kind", "burned_in": "burned"}).collect()}
    assert got[1]["classes"] == [f"c{n}" for n in range(64)] + ["unsupported-overflow"] and got[1]["modalities"] == ["MR"] and got[1]["burned_in"] == []
    assert (got[2]["classes"], got[2]["modalities"], got[2]["burned_in"]) == (["z", "y"], ["MR", "CT"], ["NO"])


def header(n, **other):
    found = {
        (8, 8): ("CS", ["ORIGINAL", "PRIMARY"]), (8, 0x16): ("UI", ["1.2.840.10008.5.1.4.1.1.4"]), (8, 0x18): ("UI", [f"1.2.{n}"]), (8, 0x60): ("CS", ["MR"]), (0x10, 0x20): ("LO", ["S"]), (0x18, 0x20): ("CS", ["EP"]), (0x18, 0x80): ("DS", ["2000"]),
        (0x20, 0xD): ("UI", ["1.3"]), (0x20, 0xE): ("UI", ["1.4"]), (0x20, 0x13): ("IS", [str(n)]), (0x20, 0x105): ("IS", ["100"]), (0x28, 0x301): ("CS", ["NO"]),
    }
    found |= other.get("also", {})
    return writer.encoded([([], g, e, vr, v, 0) for (g, e), (vr, v) in found.items() if v is not None])


def decided(spark, files):
    frame = spark.createDataFrame(files, "file string, content binary")
    rows = headers.series_rows(headers.header_rows(writer.parsed(frame)), frame.select("file", F.length("content").cast("long").alias("bytes")))
    return sorted((r["instances"], r["kind"]) for r in rules.classified(rows).collect())


def test_gates_over_files(spark):
    assert decided(spark, [(f"a/{n}", header(n)) for n in range(4)]) == [(4, "functional_epi")]
    assert decided(spark, [("a/1", header(1)), ("a/2", header(2, also={(0x20, 0xD): ("UI", None)})), ("b/3", b"broken")]) == [(1, "functional_epi"), (1, "missing_required_uid")]
    # spelling of texts does not matter, order of sets neither; missing values agree with all
    same = [header(1, also={(8, 0x70): ("LO", ["Siemens Healthineers"]), (0x18, 0x5100): ("CS", ["HFS"])}), header(2, also={(8, 0x70): ("LO", ["SIEMENS"])}), header(3, also={(0x18, 0x5100): ("CS", ["hfs"])})]
    assert decided(spark, [(f"a/{n}", c) for n, c in enumerate(same)]) == [(3, "functional_epi")]
    other = [header(1, also={(0x18, 0x21): ("CS", ["SK", "SP"])}), header(2, also={(0x18, 0x21): ("CS", ["SP", "SK"])}), header(3, also={(0x18, 0x21): ("CS", ["SP"])})]
    assert decided(spark, [("a/1", other[0]), ("a/2", other[1])]) == [(2, "functional_epi")]
    assert decided(spark, [("a/1", other[0]), ("a/3", other[2])]) == [(2, "inconsistent_series_metadata")]


def test_whole_files_give_the_rows_that_elements_give_without_a_shuffle(spark):
    from gneiss.plans import files
    from gneiss.sources import part10, writer

    orders = spark.range(50).select(F.col("id").alias("o_orderkey"))
    lines = spark.range(100).selectExpr("id % 50 as l_orderkey", "cast(id % 2 + 1 as int) as l_linenumber")
    written = files.series_files(orders, lines).cache()
    whole = headers.header_rows_whole(writer.parsed_whole(written))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, headers.header_rows(writer.parsed(written)).collect()))
    plan = headers.header_rows_whole(writer.parsed_whole(spark.createDataFrame([], "file string, content binary")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # the short way through a file and the walk over its events agree, on damaged files too
    for row in written.limit(10).collect():
        for content in (bytes(row["content"]), bytes(row["content"])[:-3], bytes(row["content"])[:200] + b"\xff" + bytes(row["content"])[201:]):
            try:
                theirs = [list(c) for c in zip(*part10.tree(content))]
            except part10.Broken:
                continue
            assert part10.columns(content) == theirs
