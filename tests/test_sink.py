"""Archives that stream: constant memory over 3 GiB, the same bytes again, nothing left of what fails."""

from __future__ import annotations

import hashlib
import io
import tracemalloc

import pytest
from pyspark.sql import functions as F

from gneiss.sources import archives, sink


class Zeros(io.RawIOBase):
    def __init__(self, size):
        self.left = size

    def read(self, n=-1):
        n = min(self.left, 1 << 20 if n < 0 else n)
        self.left -= n
        return bytes(n)


class Nowhere:
    def write(self, data):
        return len(data)

    def flush(self):
        pass


def test_three_gib_stream_in_constant_memory():
    size = 1 << 30
    tracemalloc.start()
    files, total, packed, digest = sink.stream_archive("s", ((lambda: Zeros(size), size) for _ in range(3)), Nowhere())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (files, total) == (3, 3 << 30) and packed < 10 << 20 and len(digest) == 64
    assert peak < 64 << 20


@pytest.fixture()
def files(spark, tmp_path):
    rows, contents = [], {}
    for s in range(5):
        for n in range(s + 1):
            data = f"{s}-{n}".encode() * (1000 * n + 1)
            path = tmp_path / f"in-{s}-{n}"
            path.write_bytes(data)
            rows.append((f"series.{s}", None if n == 3 else 10 - n, f"u{n}", f"file://{path}" if n % 2 else str(path), len(data)))
            contents.setdefault(f"series.{s}", []).append((None if n == 3 else 10 - n, data))
    frame = spark.createDataFrame(rows, "series_id string, number int, uid string, path string, size long")
    ordered = {s: [d for _, d in sorted(c, key=lambda x: (x[0] is None, x[0] or 0))] for s, c in contents.items()}
    return frame, ordered


def test_archives_hold_their_files_in_order_and_come_out_alike(spark, tmp_path, files):
    frame, ordered = files
    root = f"file://{tmp_path}/out"
    one = sorted(map(tuple, sink.write_archives(frame, root).collect()))
    two = sorted(map(tuple, sink.write_archives(frame.orderBy(F.rand(3)), root).collect()))
    assert one == two and len(one) == 5
    for series, path, n, size, packed, digest in one:
        data = (tmp_path / "out" / f"{series}.tar.zst").read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (packed, digest) and (n, size) == (len(ordered[series]), sum(map(len, ordered[series])))
    members = archives.read_archives(spark, root).filter("member <> 'manifest.json'").orderBy("path", "member").collect()
    got: dict[str, list] = {}
    for m in members:
        got.setdefault(m["path"].rpartition("/")[2].removesuffix(".tar.zst"), []).append(m["sha256"])
    assert got == {s: [hashlib.sha256(d).hexdigest() for d in c] for s, c in ordered.items()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"series.{s}.tar.zst" for s in range(5)]


@pytest.mark.parametrize("wrong", [-1, 1])
def test_a_file_of_another_length_leaves_nothing(spark, tmp_path, files, wrong):
    frame, _ = files
    changed = frame.withColumn("size", F.when(F.col("uid") == "u4", F.col("size") + wrong).otherwise(F.col("size")))
    with pytest.raises(Exception, match="shorter|longer"):
        sink.write_archives(changed.filter("series_id = 'series.4'"), str(tmp_path / "bad")).collect()
    assert list((tmp_path / "bad").iterdir()) == []
    with pytest.raises(Exception, match="cannot name"):
        sink.write_archives(frame.withColumn("series_id", F.lit("../x")), str(tmp_path / "bad")).collect()
