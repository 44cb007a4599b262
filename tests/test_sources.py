"""Header files, vendor blocks and archives that the tests make themselves."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import functions as F

from gneiss.sources import archives, csa, part10
from gneiss.streaming import lifecycle


def element(grp, elem, vr, value):
    value = value if isinstance(value, bytes) else value.encode()
    value += b" " * (len(value) % 2)
    if vr in part10.LONG:
        return struct.pack("<HH2sHI", grp, elem, vr.encode(), 0, len(value)) + value
    return struct.pack("<HH2sH", grp, elem, vr.encode(), len(value)) + value


def item(*parts, open_=False):
    body = b"".join(parts)
    return struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF if open_ else len(body)) + body + (struct.pack("<HHI", 0xFFFE, 0xE00D, 0) if open_ else b"")


def header(*parts, syntax="1.2.840.10008.1.2.1"):
    return b"\0" * 128 + b"DICM" + element(2, 0x10, "UI", syntax) + b"".join(parts)


def test_elements_of_nested_files(spark, tmp_path):
    open_sequence = struct.pack("<HH2sHI", 8, 0x1140, b"SQ", 0, 0xFFFFFFFF) + item(element(8, 0x1150, "UI", "1.2"), open_=True) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    closed = element(0x40, 0x260, "SQ", item(element(8, 0x100, "SH", "A"), element(8, 0x104, "LO", "B\\C")))
    private = element(0x19, 0x10, "LO", "MAKER") + element(0x19, 0x100C, "IS", "7")
    data = header(element(8, 0x60, "CS", "MR"), open_sequence, private, element(0x28, 0x10, "US", struct.pack("<H", 64)), closed, element(0x7FE0, 0x10, "OW", b"\0" * 64))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.dcm").write_bytes(data)
    (tmp_path / "b").write_bytes(data[:150])
    (tmp_path / "notes.txt").write_text("no header")
    rows = part10.read_elements(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
    good = [(r["depth"], r["grp"], r["elem"], r["vr"], list(r["values"]), r["creator"]) for r in rows if r["path"].endswith("a.dcm")]
    assert good == [
        (0, 2, 0x10, "UI", ["1.2.840.10008.1.2.1"], None), (0, 8, 0x60, "CS", ["MR"], None), (0, 8, 0x1140, "SQ", [], None), (1, 8, 0x1150, "UI", ["1.2"], None),
        (0, 0x19, 0x10, "LO", ["MAKER"], None), (0, 0x19, 0x100C, "IS", ["7"], "MAKER"), (0, 0x28, 0x10, "US", ["64"], None),
        (0, 0x40, 0x260, "SQ", [], None), (1, 8, 0x100, "SH", ["A"], None), (1, 8, 0x104, "LO", ["B", "C"], None),
    ]
    broken = [r for r in rows if r["path"].endswith("/b")]
    assert broken and broken[-1]["error"]
    heads = {r["path"].rpartition("/")[2]: (r["modality"], r["error"] is None) for r in part10.headers(part10.read_elements(spark, str(tmp_path)), {"modality": (8, 0x60)}).collect()}
    assert heads == {"a.dcm": ("MR", True), "b": (None, False)}
    assert part10.inventory(spark, str(tmp_path)).count() == 3


def test_both_byte_orders_blocks_and_pixel_spans(spark, tmp_path):
    big = lambda grp, elem, vr, raw: struct.pack(">HH2sH", grp, elem, vr.encode(), len(raw)) + raw
    pixels = struct.pack(">HH2sHI", 0x7FE0, 0x10, b"OW", 0, 4) + b"abcd"
    data = header(big(8, 0x60, "CS", b"MR"), big(0x28, 0x10, "US", struct.pack(">H", 64)), pixels, syntax="1.2.840.10008.1.2.2 ")
    found = list(part10.elements(data))
    assert [(e[2], e[3], e[5]) for e in found[1:]] == [(8, 0x60, ["MR"]), (0x28, 0x10, ["64"])]
    items = struct.pack(">HH2sHI", 8, 0x1140, b"SQ", 0, 18) + struct.pack(">HHI", 0xFFFE, 0xE000, 10) + big(0x28, 0x10, "US", struct.pack(">H", 7))
    assert [e[5] for e in part10.elements(header(items, syntax="1.2.840.10008.1.2.2 "))][-1] == ["7"]
    block_ = bytes(range(256)) * 64
    small = header(element(0x29, 0x1010, "OB", block_), element(0x7FE0, 0x10, "OW", b"pixels"))
    assert list(part10.elements(small))[-1][5] == [block_.hex()]
    (tmp_path / "big.dcm").write_bytes(data)
    (tmp_path / "small.dcm").write_bytes(small)
    got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in part10.pixel_spans(spark, str(tmp_path)).collect()}
    assert got == {"big.dcm": (4, hashlib.sha256(b"abcd").hexdigest()), "small.dcm": (6, hashlib.sha256(b"pixels").hexdigest())}


def block(tags):
    out = b"SV10" + b"\4\3\2\1" + struct.pack("<II", len(tags), 77)
    for name, values in tags.items():
        out += name.encode().ljust(64, b"\0") + struct.pack("<I4sIII", 1, b"IS\0\0", 0, len(values), 77)
        for v in values:
            raw = v.encode() + b"\0"
            out += struct.pack("<IIII", len(raw), len(raw), 77, len(raw)) + raw.ljust((len(raw) + 3) // 4 * 4, b"\0")
    return out


def test_vendor_block(spark):
    good = block({"B_value": ["1000"], "Direction": ["0.1", "", "0.9"], "None": []})
    frame = spark.createDataFrame([(good,), (good[:-20],), (b"xx",), (None,)], "b binary")
    got = [r[0] for r in frame.select(csa.csa_values("b")).collect()]
    assert got[0] == {"B_value": ["1000"], "Direction": ["0.1", "0.9"], "None": []}
    assert got[1:] == [None, None, None]


def test_archives_repeat_and_read_back(spark):
    rows = [("s", 2, "u2", b"two"), ("s", None, "u3", b"three"), ("s", 1, "u1", b"one"), ("t", 1, "u", b"")]
    frame = spark.createDataFrame(rows, "series_id string, number int, uid string, content binary")
    one = archives.series_archives(frame).orderBy("series_id").collect()
    two = archives.series_archives(frame.orderBy(F.rand(1))).orderBy("series_id").collect()
    assert [bytes(r["archive"]) for r in one] == [bytes(r["archive"]) for r in two]
    packed = spark.createDataFrame([(r["series_id"], bytes(r["archive"])) for r in one], "path string, content binary")
    members = [(r["path"], r["member"], r["sha256"]) for r in archives.read_members(packed).orderBy("path", "member").collect() if r["member"] != "manifest.json"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert members == [("s", "dicom/000001.dcm", sha(b"one")), ("s", "dicom/000002.dcm", sha(b"two")), ("s", "dicom/000003.dcm", sha(b"three")), ("t", "dicom/000001.dcm", sha(b""))]


def test_stream_states_do_not_depend_on_batches(spark, tmp_path):
    rows = [(1, "view", 1), (1, "purchase", 5), (2, "error", 2), (2, "purchase", 1), (3, "view", 3), (4, "purchase", 4), (4, "view", 9)]
    frame = spark.createDataFrame(rows, "user_id long, event_type string, s int").withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)")).drop("s")
    frame.repartition(3).write.parquet(str(tmp_path / "events"))
    got = lifecycle.run_available(spark, str(tmp_path / "events"), "file://" + str(tmp_path / "out"))
    assert {r["user_id"]: r["status"] for r in got.collect()} == {1: "committed", 2: "withdrawn", 3: "uploading", 4: "checkpointed"}


def test_windows_in_a_stream(spark, tmp_path):
    frame = spark.createDataFrame([(i * 1200, "view", 1.0) for i in range(9)], "s int, event_type string, value double").withColumn("at", F.timestamp_seconds("s")).drop("s")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = lifecycle.window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select * from counts").collect()) == [3, 3, 3]
