"""Published versions, review folders and rebuilt macros."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import publish


def test_versions_become_visible_as_a_whole(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    one = spark.range(5).withColumnRenamed("id", "a")
    first = publish.publish(spark, root, {"series": one, "parts": one.limit(2)})
    assert publish.current(spark, root, "series").count() == 5 and publish.read_json(spark, f"{root}/current.json")["rows"] == {"series": 5, "parts": 2}
    stable = spark.createDataFrame([("f", True), ("g", None)], "folder string, stable boolean")
    with pytest.raises(RuntimeError):
        publish.publish(spark, root, {"series": one.limit(1), "parts": one}, gate=stable)
    assert publish.read_json(spark, f"{root}/current.json")["version"] == first and publish.current(spark, root, "parts").count() == 2
    publish.publish(spark, root, {"series": one.limit(1), "parts": one}, gate=stable.filter("stable"))
    assert publish.current(spark, root, "series").count() == 1 and publish.current(spark, root, "parts").count() == 5
    assert publish.read_json(spark, f"{root}/none.json") is None


def test_review_index_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c", "x\ty"), (None, "b", "l\nm"), (1, "a", None)], "series_number int, folder string, protocol string")
    path = f"{tmp_path}/index"
    assert publish.write_index(rows, path) == 3
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0].split("\t") == list(publish.INDEX) and [x.split("\t")[1] for x in lines[1:]] == ["a", "c", "b"] and "x y" in lines[2] and "l m" in lines[3]
    for name in ("one/a.dcm", "one/b.dcm", "one/review.json", "two/c.dcm", "two/notes.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(b"x")
    got = {r["folder"].rpartition("/")[2]: (r["files"], r["marked"]) for r in publish.review_folders(spark, f"{tmp_path}/r").collect()}
    assert got == {"one": (2, True), "two": (1, False)}


def test_coil_macros_are_whole_or_refused(spark):
    good = [("00181250", "Multi Coil"), ("00189041", "x"), ("00189043", "MULTICOIL"), ("00189044", "NO"), ("00189045", ""), ("00189047", "multi_element"), ("00189048", "YES"), ("00189047", "MULTIELEMENT"), ("00189048", "NO")]
    cases = {1: good, 2: good[1:], 3: [("00181250", "Head 32"), *good[1:]], 4: [*good, ("00100010", "Doe")], 5: good[:5], 6: [*good[:5], ("00189047", "own label"), ("00189048", "YES")]}
    rows = spark.createDataFrame([(1, k, t, v) for k, cells in cases.items() for t, v in cells], "file int, item int, tag string, value string")
    assert {r["item"]: (r["elements"], r["valid"]) for r in publish.rebuilt_coils(rows).collect()} == {1: (2, True), 2: (2, False), 3: (2, False), 4: (2, False), 5: (0, False), 6: (1, False)}
    assert rows.filter(F.col("tag") == "00100010").count() == 1


def test_a_reader_always_finds_a_pointer(spark, tmp_path):
    import threading

    path, seen, stop = f"file://{tmp_path}/current.json", [], threading.Event()
    publish.write_json(spark, path, {"version": 0})

    def look():
        while not stop.is_set():
            try:
                seen.append(json.loads((tmp_path / "current.json").read_text())["version"])
            except (OSError, ValueError, KeyError) as e:
                seen.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(1, 40):
        publish.write_json(spark, path, {"version": n})
    stop.set()
    reader.join()
    assert publish.read_json(spark, path) == {"version": 39}
    assert [x for x in seen if isinstance(x, Exception)] == [] and seen == sorted(seen) and len(set(seen)) > 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["current.json"]


def test_rows_of_a_task_do_not_grow_with_the_table(spark):
    from gneiss.operators import grouping

    rows = spark.range(6000).withColumn("k", F.col("id") % 1500)
    window = grouping.dealt(rows, "k", 6000, 500).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert window.rdd.getNumPartitions() == 12 and window.agg(F.sum("n")).first()[0] == 1500 * 10
    assert grouping.dealt(rows, "k", 2000, 500).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
