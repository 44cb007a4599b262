"""Scalar functions and operators on small tables of cases."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from gneiss.functions import ids, numbers, text
from gneiss.operators import grouping, redact, relations, rules, state


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def applied(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("x"))).collect()]


def test_labels(spark):
    assert applied(spark, [" Resting-State / AP ", "__", None, "É1"], text.protocol_label) == ["resting_state_ap", "", None, "1"]
    assert applied(spark, [" a  b\tc ", "ß"], text.normal_text) == ["A B C", "ß"]
    assert applied(spark, ["b\\a\\\\ B", ""], text.normal_list) == [["A", "B"], []]
    assert applied(spark, ["x DWI y", "dwi", None], lambda x: text.contains_any(x, [" dwi"])) == [True, False, False]
    assert applied(spark, ["t1_w", "t10", None], lambda x: text.has_token(x, ["t1"])) == [True, False, False]
    assert applied(spark, ["abé", "abcd", "日本"], lambda x: text.cut_bytes(x, 3)) == ["ab", "abc", "日"]
    assert applied(spark, ["Head 12", "a@b.de", "1234567", "http://x", "", "patient x"], text.bounded_label) == ["Head 12", None, None, None, None, None]
    assert applied(spark, ["SE\\ep\\SE", "xx", None], lambda x: text.code_list(x, ["SE", "EP"])) == ["SE\\EP", None, None]
    assert applied(spark, ['"abc"', "abc"], text.unquoted_tag) == ["abc", "abc"]
    assert applied(spark, ["A@B.org", "x", "a b@c.d"], text.mail_address) == ["a@b.org", None, None]


def test_versions_sort(spark):
    order = ["1.2.3-alpha", "1.2.3", "1.2.10-rc.1", "1.2.10+build", "1.10.0"]
    rows = column(spark, order[::-1] + ["no"])
    assert [r["x"] for r in rows.filter(text.version_key(F.col("x")).isNotNull()).orderBy(text.version_key(F.col("x"))).collect()] == order


def test_keyed_digest_is_hmac(spark):
    for key in (b"k", b"x" * 64, b"y" * 80):
        got = applied(spark, ["", "abc", "é"], lambda x: ids.keyed_digest(key, F.encode(x, "UTF-8")))
        assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("", "abc", "é")]


def test_identifiers(spark):
    same = applied(spark, [" a", "a ", "a"], lambda x: ids.pseudonym(b"k", "n", x))
    other = applied(spark, ["a"], lambda x: ids.pseudonym(b"k", "m", x))
    assert len(set(same)) == 1 and len(same[0]) == 24 and other[0] != same[0]
    uid = applied(spark, ["1.2.3"], lambda x: ids.remapped_uid(b"k", x))[0]
    want = int(hmac.new(b"k", b"v1\0uid\x001.2.3", hashlib.sha256).hexdigest()[:24], 16)
    assert uid == f"2.25.{want}"
    assert applied(spark, ["p"], lambda x: ids.canonical_json(b=x, a=F.lit(1), c=F.lit(None).cast("int"))) == ['{"a":1,"b":"p"}']


def test_part_sizes(spark):
    mib = 1 << 20
    sizes = [1, 64 * mib, 64 * mib + 1, 640_000 * mib, 640_000 * mib + 1]
    assert applied(spark, sizes, numbers.part_size, "long") == [64 * mib] * 4 + [65 * mib]
    assert applied(spark, sizes, numbers.part_count, "long") == [1, 1, 2, 10_000, 9847]
    assert applied(spark, sizes, numbers.last_part, "long")[:3] == [1, 64 * mib, 1]


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.floats_agree(F.lit(1000.0), F.lit(1001.0)), numbers.floats_agree(F.lit(1.0), F.lit(2.5)), numbers.is_unit_vector(F.array(F.lit(1.0), F.lit(0.1))),
        numbers.retry_delay_ms(F.lit(3), F.lit(99_000)), numbers.pixel_bytes(F.lit(3), F.lit(3), F.lit(1), F.lit(1), F.lit(8)), numbers.iso_time(F.lit(0)),
    ).first()
    assert tuple(row) == (True, False, True, 30_000, 10, "1970-01-01T00:00:00.000Z")


def test_grouping(spark):
    rows = spark.createDataFrame([("s", 2, "b", "v2"), ("s", 1, "c", None), ("s", 1, "d", "v1"), (None, None, "e", "x"), ("", 1, "f", "y")], "uid string, n int, path string, v string")
    key = grouping.isolated(F.col("uid"), F.col("path"))
    got = {r["k"]: (r["p"], r["v"]) for r in rows.groupBy(key.alias("k")).agg(grouping.representative(F.col("path"), F.col("n"), F.col("path")).alias("p"), grouping.first_known(F.col("v"), F.col("n"), F.col("path")).alias("v")).collect()}
    assert got == {"s": ("c", "v1"), "missing:e": ("e", "x"), "missing:f": ("f", "y")}
    many = spark.range(200).select(F.lit("k").alias("k"), (F.col("id") % 70).alias("v"), "id")
    values = grouping.bounded_distinct(many, "k", "v", "id", 64, "more").first()["values"]
    assert values == [str(i) for i in range(64)] + ["more"]
    exact = grouping.bounded_distinct(many.filter("v < 64"), "k", "v", "id", 64, "more").first()["values"]
    assert exact == [str(i) for i in range(64)]


GATED = """study_uid string, series_uid string, duplicate_instance boolean, instances long, unreadable long, largest long, bytes long, mixed_subject boolean, metadata_conflict boolean,
    classes array<string>, secondary_classes array<string>, allowed_classes array<string>, modalities array<string>, burned_in array<string>, overlay_or_graphics boolean, burned_in_missing boolean,
    enhanced boolean, all_original_primary boolean, mosaic boolean, csa_safe boolean, grid boolean, grid_verified boolean, diffusion boolean, diffusion_verified boolean, asl boolean,
    asl_verified boolean, private_scaling boolean, private_scaling_verified boolean, functional boolean"""


def test_gates_decide_in_order(spark):
    fine = ("1", "2", False, 10, 0, 5, 50, False, False, ["mr"], ["sc"], ["mr", "emr"], ["MR"], ["NO"], False, False, False, True, False, False, False, False, False, False, False, False, False, False, True)
    names = [c.split()[0] for c in GATED.replace("\n", " ").split(",")]
    changes = [
        ({}, "functional_epi"), ({"functional": False}, "not_functional_epi"), ({"series_uid": ""}, "missing_required_uid"), ({"duplicate_instance": True}, "invalid_sop_instance_identity"),
        ({"instances": 500_001}, "series_exceeds_dicom_instance_limit"), ({"instances": 500_000}, "functional_epi"), ({"unreadable": 1}, "source_file_changed_or_unreadable"),
        ({"classes": ["sc"]}, "secondary_capture"), ({"classes": ["mr", "ct"]}, "unsupported_sop_class"), ({"modalities": ["MR", "CT"], "overlay_or_graphics": True}, "not_mr"),
        ({"burned_in": ["YES"]}, "burned_in_annotation"), ({"burned_in_missing": True, "enhanced": True}, "enhanced_mr_burned_in_annotation_not_declared"),
        ({"mosaic": True}, "classic_mosaic_requires_safe_csa"), ({"mosaic": True, "csa_safe": True}, "functional_epi"),
        ({"diffusion": True, "asl": True, "diffusion_verified": True, "asl_verified": True}, "ambiguous_diffusion_and_asl_scientific_context"),
        ({"private_scaling": True}, "philips_private_scientific_metadata_incomplete"),
    ]
    rows = [tuple((dict(zip(names, fine)) | c)[n] for n in names) for c, _ in changes]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {GATED}")
    frame = frame.withColumn("acquired_diffusion", F.col("diffusion"))
    got = [r[0] for r in frame.orderBy("i").select(rules.classify_series(F.col("functional")).getField("kind")).collect()]
    assert got == [k for _, k in changes]


def test_writes(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, None)], "k int, id int, v string")
    new = spark.createDataFrame([(2, 99, "b"), (3, 30, None)], "k int, id int, v string")
    assert sorted(map(tuple, state.upsert(old, new, "k", ["id"], ["v"]).collect())) == [(1, 10, "a"), (2, 20, "b"), (3, 30, None)]
    times = spark.createDataFrame([("u", t) for t in (0, 5, 9, 10, 12, 19, 21, 60, 65)], "u string, t long")
    assert sorted(r["t"] for r in state.lease_grants(times, "u", "t", 10).collect()) == [0, 10, 21, 60]
    sizes = spark.createDataFrame([("r", i, s) for i, s in enumerate([4, 4, 4, 20, 1, 1, 1, 1])], "r string, i int, size long")
    packed = state.pack_in_order(sizes, "r", ["i"], "size", 3, 10)
    assert [r["chunk"] for r in packed.orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]


def test_diff_and_publication(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), ("r", None)], "path string, size int")
    b = spark.createDataFrame([("q", 3), ("r", None), ("s", 4)], "path string, size int")
    assert dict(map(tuple, relations.snapshot_diff(a, b, "path", ["size"]).collect())) == {"p": "missing", "q": "changed", "r": "same", "s": "added"}
    got = [r[0] for r in column(spark, [5, 6, 7, None], "int").orderBy("i").select(relations.publication(F.col("x"), F.lit(6))).collect()]
    assert got == ["published", "published", "staged", None]


def test_redaction_leaves_no_violation(spark):
    rows = [("f", 0, "name", "LO", " a "), ("f", 1, "made", "DA", "2020"), ("f", 2, "note", "LT", "secret"), ("f", 3, "type", "CS", "x")]
    frame = spark.createDataFrame(rows, "file string, depth int, name string, kind string, value string")
    allowed = [("name", "LO"), ("type", "CS"), ("made", "DA")]
    assert sorted(r["value"] for r in redact.project(frame, allowed).collect()) == ["A", "X"]
    assert tuple(redact.audit(redact.project(frame, allowed), allowed).first()) == (2, 0)
    assert redact.audit(frame, allowed).first()["violations"] == 4


def test_plans_keep_their_shape(spark):
    from gneiss.plans import catalogue  # noqa: F401
    from gneiss.plans.registry import QUERIES

    plan = QUERIES["archive_listing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sealed_values_belong_to_their_row(spark):
    from gneiss.functions import secrets

    key, nonce = F.lit(b"0123456789abcdef"), F.lit(b"abcdefghijkl")
    rows = column(spark, ["a@b.org", ""]).withColumn("row", F.col("i").cast("string"))
    sealed = rows.withColumn("s", secrets.seal(key, F.col("x"), nonce, F.col("row")))
    got = sealed.orderBy("i").select(secrets.unseal(key, F.col("s"), F.col("row")), secrets.unseal(key, F.col("s"), F.lit("9")), secrets.unseal(F.lit(b"x" * 16), F.col("s"), F.col("row"))).collect()
    assert [tuple(r) for r in got] == [("a@b.org", None, None), ("", None, None)]


class FakeState:
    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_timer_ends_idle_uploads():
    import pandas as pd

    from gneiss.streaming.lifecycle import advance

    events = lambda *kinds: iter([pd.DataFrame({"event_type": list(kinds), "at_us": range(10, 10 + len(kinds))})])
    for kinds, before, after in ((("view", "click"), "uploading", "expired"), (("view", "purchase"), "committed", "committed"), (("purchase", "error"), "withdrawn", "withdrawn")):
        state = FakeState()
        assert next(advance((7,), events(*kinds), state, 5000))["status"].iat[0] == before and state.timeout == 5000
        state.hasTimedOut = True
        assert next(advance((7,), iter([]), state, 5000))["status"].iat[0] == after and state.value is None


def test_upper_case_by_character_agrees_with_sql(spark):
    import duckdb

    from gneiss.plans.registry import SQL
    from gneiss.plans.validators import span_audit

    chars = [chr(c) for c in range(1, 0x1FFFF) if not 0xD800 <= c < 0xE000]
    ours = spark.createDataFrame([(c,) for c in chars], "x string").select("x", text.upper_by_character(F.concat(F.lit("a"), "x", F.lit("b"))).alias("y")).toPandas()
    theirs = duckdb.connect().execute("select upper('a' || x || 'b') from ours").fetchall()
    assert [r[0] for r in theirs] == list(ours["y"])
    texts = [(5, "0123456789 12 34"), (10, "ŉßﬁ0123456789 12 34"), (15, "0123456789 \U0001f600 ŉ ﬁ"), (20, "0123456789 ß"), (25, None), (30, ""), (35, "ßßßßß" * 4 + "1" * 30), (7, "ŉ" * 30)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert sorted(map(tuple, span_audit(lambda _: documents).collect())) == sorted(con.execute(SQL["span_audit"]).fetchall())
