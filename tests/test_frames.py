"""Functional groups resolved to frames, tolerant distinct values against a loop, and names that are registered once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import gneiss.plans.validators  # noqa: F401  (it registers one_vendor)
from gneiss.operators import frames, ledger
from gneiss.plans.registry import query
from gneiss.sources import writer


def macro(path, weight, direction="NONE", items=1):
    inner = [*path, "00189117[0]"]
    return [(path, 0x18, 0x9117, "SQ", [], items), (inner, 0x18, 0x9087, "FD", [weight], 0), (inner, 0x18, 0x9075, "CS", [direction], 0)]


def groups(shared, per_frame):
    rows = [([], 8, 0x16, "UI", ["1.2.840.10008.5.1.4.1.1.4.1"], 0), ([], 0x5200, 0x9229, "SQ", [], 1), ([], 0x5200, 0x9230, "SQ", [], len(per_frame))]
    rows += macro(["52009229[0]"], shared) if shared else []
    for n, weight in enumerate(per_frame):
        rows += macro([f"52009230[{n}]"], weight) if weight else []
    return writer.encoded(rows)


def test_frames_override_what_is_shared(spark):
    files = [(1, groups("0.0", [None, "5.0", None])), (2, groups(None, ["1.0", None])), (3, groups("2.0", []))]
    rows = writer.parsed(spark.createDataFrame(files, "file long, content binary"))
    got = sorted((r["file"], r["frame"], r["source"], (r["values"] or {}).get(frames.B_VALUE)) for r in frames.frame_macros(rows, frames.DIFFUSION).collect())
    assert got == [(1, 0, "shared", "0.0"), (1, 1, "frame", "5.0"), (1, 2, "shared", "0.0"), (2, 0, "frame", "1.0"), (2, 1, None, None)]
    judged = {r["file"]: (r["present"], r["frames"], r["shared"], r["valid"]) for r in frames.frame_contracts(rows).collect()}
    assert judged == {1: (True, 3, 2, True), 2: (True, 2, 0, False), 3: (True, 0, 0, False)}


def test_a_macro_of_two_items_or_a_root_value_breaks_the_contract(spark):
    two = [([], 8, 0x16, "UI", ["1.2.840.10008.5.1.4.1.1.4.1"], 0), ([], 0x5200, 0x9229, "SQ", [], 1), *macro(["52009229[0]"], "1.0", items=2), ([], 0x5200, 0x9230, "SQ", [], 1)]
    both = [([], 8, 0x16, "UI", ["1.2.840.10008.5.1.4.1.1.4.1"], 0), ([], 0x18, 0x9087, "FD", ["1.0"], 0), ([], 0x5200, 0x9229, "SQ", [], 1), *macro(["52009229[0]"], "1.0"), ([], 0x5200, 0x9230, "SQ", [], 1)]
    rows = writer.parsed(spark.createDataFrame([(1, writer.encoded(two)), (2, writer.encoded(both))], "file long, content binary"))
    assert {r["file"]: r["valid"] for r in frames.frame_contracts(rows).collect()} == {1: False, 2: False}


def test_first_seen_values_agree_with_a_loop(spark):
    rng = random.Random(19)
    rows = [(k, n, rng.choice([None, float("nan")]) if rng.random() < 0.05 else round(rng.uniform(-3, 3), 1), round(rng.uniform(0, 2), 1)) for k in range(60) for n in range(rng.randrange(40))]
    frame = spark.createDataFrame(rows, "k long, n long, a double, b double")
    for tolerances in ([0.5, 0.3], [0.0, 1.0]):
        want = []
        for k in range(60):
            kept: list[tuple[float, float]] = []
            for _, _, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                if a is not None and a == a and not any(abs(a - x) <= tolerances[0] and abs(b - y) <= tolerances[1] for x, y in kept):
                    kept.append((a, b))
                    want.append((k, a, b, len(kept)))
        got = ledger.first_seen_distinct(frame, "k", "n", ["a", "b"], tolerances).select("k", "a", "b", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_names_are_registered_once():
    with pytest.raises(ValueError):

        @query("SELECT 1")
        def one_vendor(table):
            return table("part").select(F.lit(1))
