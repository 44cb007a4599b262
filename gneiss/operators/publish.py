"""Batches that become visible as a whole: versions with a pointer, a stability gate before it, review folders that are read back."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of the columns of a review index.
INDEX = ("series_number", "folder", "series_id", "protocol", "description", "modality", "files", "bytes", "decision", "kind", "confidence", "evidence", "study_id", "subject_id", "archive_sha256")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON document, written beside its place and renamed over it in one step, so that readers see the old one or the new one.

    HDFS and local folders replace a file in one step; object stores put whole objects, where readers see either as well.
    """
    final, system = _files(spark, path)
    text = json.dumps(value, sort_keys=True).encode()
    if system.getUri().getScheme() == "file":  # Hadoop's local rename deletes first; its checksum file would not fit the new bytes
        place = final.toUri().getPath()
        part = f"{place}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        check = os.path.join(os.path.dirname(place), f".{os.path.basename(place)}.crc")
        if os.path.exists(check):
            os.remove(check)
        os.replace(part, place)
        return
    part, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = system.create(part, True)
    out.write(bytearray(text))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    kinds = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    files = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(part), files.makeQualified(final), options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    at, system = _files(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if system.exists(at) else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], gate: DataFrame | None = None) -> str:
    """Write all tables under a new version, then let the pointer name it.

    gate: a frame with a boolean column `stable`; one row that is false or null, or a table whose rows cannot all be read
    back, leaves the pointer as it was. Two phases: all data first, then one rename.
    """
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/versions/{version}/{name}")
    counts = {name: spark.read.parquet(f"{root}/versions/{version}/{name}").count() for name in tables}
    if gate is not None and gate.filter(~F.coalesce("stable", F.lit(False))).limit(1).count():
        raise RuntimeError("the source changed while it was written; nothing is published")
    write_json(spark, f"{root}/current.json", {"version": version, "rows": counts})
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published version."""
    return spark.read.parquet(f"{root}/versions/{read_json(spark, f'{root}/current.json')['version']}/{name}")


def cell(x: Column) -> Column:
    return F.translate(F.coalesce(x.cast("string"), F.lit("")), "\t\r\n", "   ")


def write_index(series: DataFrame, path: str) -> int:
    """The review index of INDEX's columns as tab-separated text, by number (null last) and folder; rows read back."""
    missing = [F.lit(None).cast("string").alias(c) for c in INDEX if c not in series.columns]
    rows = series.select("*", *missing).orderBy(F.col("series_number").asc_nulls_last(), "folder")
    rows.select(*[cell(F.col(c)).alias(c) for c in INDEX]).coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "").mode("overwrite").csv(path)
    back = series.sparkSession.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    n = back.count()
    if n != series.count() or tuple(back.columns) != INDEX:
        raise RuntimeError(f"{path} does not read back as it was written")
    return n


def review_folders(spark: SparkSession, root: str, marker: str = "review.json", pattern: str = "*.dcm") -> DataFrame:
    """(folder, files, marked): image files of each folder below root, and whether it holds the marker."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.regexp_extract("path", "^(.*)/([^/]*)$", 1), F.regexp_extract("path", "^(.*)/([^/]*)$", 2)
    image = parts[1].rlike("^" + pattern.replace(".", r"\.").replace("*", ".*") + "$")
    return files.groupBy(parts[0].alias("folder")).agg(F.count_if(image).alias("files"), F.bool_or(parts[1] == marker).alias("marked"))


def rebuilt_coils(items: DataFrame) -> DataFrame:
    """(file, item, elements, valid): multi-coil macros (file, item, tag, value) rebuilt as a unit.

    Valid with exactly the five fields of the macro, 1 to 256 elements and generic names only; then names are the generic
    ones, makers empty, and the element rows keep only their use flags.
    """
    fields = ("00181250", "00189041", "00189043", "00189044", "00189045")
    generic = F.regexp_replace(F.upper(F.trim("value")), "[ _]", "")
    named = F.bool_and(F.when(F.col("tag") == "00181250", generic == "MULTICOIL").when(F.col("tag") == "00189047", generic == "MULTIELEMENT").otherwise(True))
    own = F.array_sort(F.collect_set(F.when(F.col("tag").isin(*fields), F.col("tag"))))
    known = F.bool_and(F.col("tag").isin(*fields, "00189047", "00189048"))
    elements, flags = F.count_if(F.col("tag") == "00189047"), F.count_if((F.col("tag") == "00189048") & F.col("value").isin("YES", "NO"))
    found = items.groupBy("file", "item").agg(own.alias("own"), named.alias("named"), known.alias("known"), elements.alias("elements"), flags.alias("flags"))
    fine = (F.col("own") == F.array(*map(F.lit, fields))) & F.col("named") & F.col("known") & F.col("elements").between(1, 256) & (F.col("flags") == F.col("elements"))
    return found.select("file", "item", "elements", F.coalesce(fine, F.lit(False)).alias("valid"))
