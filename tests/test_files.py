"""Ranged reading, fragments, the writer, and nested elements as intervals."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from gneiss.operators import tree
from gneiss.sources import fragments, part10, ranged, writer

SEQUENCE_END = struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def item(body):
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body


def pixels(body, size=None):
    return struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, len(body) if size is None else size) + body


def nested(rng, depth=0, path=()):
    """Rows of a random data set, sequences and empty items among them."""
    rows = []
    for n in range(rng.randrange(1, 4)):
        if depth < 3 and rng.random() < 0.4:
            items = rng.randrange(3)
            own = [(list(path), 0x40, 0x100 + n, "SQ", [], items)]
            inside = [r for i in range(items) for r in (nested(rng, depth + 1, (*path, f"{0x40:04X}{0x100 + n:04X}[{i}]")) if rng.random() < 0.8 else [])]
            rows += own + inside
        else:
            rows.append((list(path), 0x28, 0x100 + n, "US", [str(rng.randrange(99))], 0))
    return rows


def test_written_files_read_back_with_their_subtrees():
    rng = random.Random(2)
    for _ in range(200):
        rows = nested(rng)
        back = part10.tree(writer.encoded(rows))[2:]  # without the meta group
        key = lambda r: (r[0], r[1], r[2])
        assert sorted(((list(p), g, e, vr, v, n or 0) for _, p, g, e, vr, v, _, _, n in back), key=key) == sorted(rows, key=key)
        for at, (depth, path, g, e, vr, _, _, last, _) in enumerate(back, 2):
            below = [n for n, r in enumerate(back, 2) if len(r[1]) > len(path) and r[1][: len(path)] == path and r[1][len(path)].startswith(f"{g:04X}{e:04X}[")]
            assert last == (max(below) if below else at) and below == list(range(at + 1, last + 1))
    with pytest.raises(ValueError):
        writer.encoded([(["00400100[0]"], 8, 8, "CS", ["A"], 0)])


def test_dropped_sequences_take_their_subtrees(spark):
    rng = random.Random(3)
    files = [(n, writer.encoded(nested(rng))) for n in range(30)]
    parsed = writer.parsed(spark.createDataFrame(files, "file long, content binary")).filter("grp <> 2").withColumn("gone", F.pmod(F.xxhash64("file", "ordinal"), F.lit(4)) == 0)
    rows = [r.asDict() for r in parsed.collect()]
    left = {(r["file"], r["ordinal"]) for r in tree.without_subtrees(parsed, F.col("gone")).collect()}
    gone = {(r["file"], tuple(r["item_path"]) + (f"{r['grp']:04X}{r['elem']:04X}",)) for r in rows if r["gone"]}

    def stays(r):
        path = [p.partition("[")[0] for p in r["item_path"]]
        above = [tuple(r["item_path"][:n]) + (path[n],) for n in range(len(path))]
        return not r["gone"] and not any((r["file"], a) in gone for a in above)

    assert left == {(r["file"], r["ordinal"]) for r in rows if stays(r)}
    assert 0 < len(left) < len(rows)


def test_part_files_are_written_on_all_cores_and_parsed_once(spark):
    """A small table is one task's read, and creators came from a second branch that parsed and judged all files again."""
    from gneiss.plans import files

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert part.rdd.getNumPartitions() == 1
    assert files.spread(part).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = tree.sanitised_tree(files.flagged(writer.parsed(files.source_files(part))), files.KEY)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_audit_sees_what_must_go(spark):
    dirty = [([], 8, 8, "CS", ["ORIGINAL", "PRIMARY", "M"], 0), ([], 0x10, 0x10, "PN", ["Doe^Jane"], 0), ([], 8, 0x20, "DA", ["20240101"], 0), ([], 0x19, 0x10, "LO", ["SIEMENS MR HEADER"], 0), ([], 0x28, 0x10, "US", ["4"], 0)]
    clean = [dirty[0], dirty[4]]
    off = F.lit(False)
    rows = writer.parsed(spark.createDataFrame([(1, writer.encoded(dirty)), (2, writer.encoded(clean)), (3, writer.encoded(clean[1:]))], "file long, content binary"))
    rows = rows.withColumns({"enhanced": off, "trigger_redundant": off, "offsets_valid": off, "vendor": F.lit("SIEMENS")})
    got = {r["file"]: (r["violations"], r["image_type"]) for r in tree.audit(rows, b"k" * 32).collect()}
    assert got == {1: (3, True), 2: (0, True), 3: (0, False)}


def test_broken_bytes_give_an_error_row(spark):
    rows = writer.parsed(spark.createDataFrame([(1, b"no header"), (2, writer.encoded([([], 8, 8, "CS", ["A"], 0)])[:-2])], "file long, content binary")).collect()
    assert sorted((r["file"], r["error"] is not None) for r in rows if r["error"] or r["ordinal"] == 0) == [(1, True), (2, True)]


def test_fragments_end_at_their_delimiter():
    body = item(b"") + item(b"ab") + item(b"cdef")
    data = body + SEQUENCE_END + b"trailing"
    assert fragments.fragment_rows(data, 0) == ([(0, 0, 2), (1, 10, 4)], 0, None)
    assert fragments.fragment_rows(item(b"\0" * 8) + item(b"ab") + SEQUENCE_END, 0)[:2] == ([(0, 0, 2)], 8)
    broken = {"no_delimiter": body, "truncated": body[:-1], "not_an_item": body + b"\x08\0\x08\0\2\0\0\0AB", "odd_length": item(b"") + item(b"abc"), "empty": item(b"") + item(b"") + SEQUENCE_END, "open_item": item(b"") + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF)}
    for problem, bytes_ in broken.items():
        assert fragments.fragment_rows(bytes_, 0)[2] == problem
    assert fragments.fragment_rows(b"", 0)[2] == "no_delimiter"


class Counted:
    """A file of any length whose bytes after `head` are zero, that counts what is read."""

    def __init__(self, head, size):
        self.head, self.size, self.at, self.count = head, size, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        n = min(n, self.size - self.at)
        assert n < 1 << 20
        out = self.head[self.at : self.at + n].ljust(n, b"\0")
        self.at, self.count = self.at + n, self.count + n
        return out


def test_ranges_stop_before_pixels():
    many = [([], 0x28, 0x100 + n, "US", ["7"], 0) for n in range(3000)] + [([], 0x40, 0x100, "SQ", [], 1), (["00400100[0]"], 8, 0x100, "SH", ["x"], 0)]
    head = writer.encoded(many, pixels(b"", 5 << 30 & 0xFFFFFFFE))
    file = Counted(head, len(head) + (6 << 30))  # far over 2 GiB
    data = ranged.Ranged(file, file.size)
    assert part10.tree(data) == part10.tree(head + b"\0" * 16) and len(part10.tree(data)) == 3004
    file = Counted(head, len(head) + (6 << 30))
    part10.tree(ranged.Ranged(file, file.size))
    assert file.count <= 2 * len(head) + ranged.LEAST
    big = writer.encoded([([], 9, 0x10, "LO", ["X"], 0)], writer.element(9, 0x1001, "OB", b"\0" * (20 << 20)) + pixels(b"ab"))
    file = Counted(big, len(big))
    part10.tree(ranged.Ranged(file, file.size))
    assert file.count < 10_000  # a long value is passed over


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    plain = [([], 8, 0x60, "CS", ["MR"], 0), ([], 8, 0x1140, "SQ", [], 1), (["00081140[0]"], 8, 0x1155, "UI", ["1.2"], 0)]
    (root / "a.dcm").write_bytes(writer.encoded(plain, pixels(b"abcd" * 50_000)))
    (root / "sub" / "b").write_bytes(writer.encoded(plain, pixels(item(b"") + item(b"xy") + item(b"zzzz") + SEQUENCE_END + b"trailer", 0xFFFFFFFF)))
    (root / "sub" / "c.dcm").write_bytes(b"broken")
    (root / "notes.txt").write_text("nothing")
    return root


def test_data_source(spark, folder):
    spark.dataSource.register(ranged.Part10Source)
    rows = spark.read.format("part10").option("files", 1).load(str(folder))
    assert rows.rdd.getNumPartitions() == 4
    got = {}
    for r in rows.orderBy("path", "ordinal").collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["grp"], r["elem"], r["last"], r["items"], r["error"] is not None))
    assert got["a.dcm"] == got["b"] == [(2, 0, 0, None, False), (2, 0x10, 1, None, False), (8, 0x60, 2, None, False), (8, 0x1140, 4, 1, False), (8, 0x1155, 4, None, False)]
    assert got["c.dcm"] == [(None, None, None, None, True)] and set(got) == {"a.dcm", "b", "c.dcm"}
    assert spark.read.format("part10").load(f"file://{folder}/a.dcm").count() == 5
    spans = spark.read.format("part10").option("rows", "fragments").option("digest", "true").load(str(folder)).collect()
    found = {r["path"].rpartition("/")[2]: r for r in spans}
    assert found["a.dcm"]["sha256"] == hashlib.sha256(b"abcd" * 50_000).hexdigest() and found["a.dcm"]["bytes_read"] < 5000
    b = found["b"]
    assert [tuple(f) for f in b["fragments"]] == [(0, 0, 2), (1, 10, 4)] and b["length"] == 8 * 4 + 6 and b["error"] is None
    assert b["sha256"] == hashlib.sha256(item(b"") + item(b"xy") + item(b"zzzz") + SEQUENCE_END).hexdigest()  # the trailer does not count
    assert found["c.dcm"]["error"] == "no DICM mark"


def test_offset_table_statuses(spark):
    found = [(0, 0, 2), (1, 10, 4)]
    cases = {
        "valid": ([0, 10], [1, 4], 2, found, 0, None, True),
        "absent": (None, None, 2, found, 0, None, True),
        "half_a_table": ([0, 10], None, 2, found, 0, None, True),
        "uneven_table": ([0, 10], [1], 2, found, 0, None, True),
        "not_rising": ([0, 0], [1, 4], 2, found, 0, None, True),
        "empty_frame": ([0, 10], [0, 4], 2, found, 0, None, True),
        "frame_count": ([0, 10], [1, 4], 3, found, 0, None, True),
        "not_encapsulated": ([0, 10], [1, 4], 2, [], 0, None, False),
        "fragments:truncated": ([0, 10], [1, 4], 2, [], 0, "truncated", True),
        "basic_table": ([0, 10], [1, 4], 2, found, 4, None, True),
        "fragment_not_listed": ([0], [2], None, found, 0, None, True),
        "fragment_missing": ([0, 10, 22], [2, 4, 2], 3, found, 0, None, True),
        "offset_elsewhere": ([0, 12], [2, 4], 2, found, 0, None, True),
        "length_differs": ([0, 10], [2, 6], 2, found, 0, None, True),
    }
    kind = "file string, offsets array<long>, lengths array<long>, frames long, fragments array<struct<number:int,offset:long,length:long>>, basic long, problem string, encapsulated boolean"
    got = fragments.offset_table_status(spark.createDataFrame([(name, *row) for name, row in cases.items()], kind)).collect()
    assert [(r["file"], r["status"]) for r in got if r["file"] != r["status"]] == []
