"""Series archives: deterministic tar files under zstd, written and read through Spark."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBERS = "path string, member string, size long, sha256 string"
#: Bytes a series may have to be packed in one task's memory; a larger one is refused before any is packed.
MOST = 1 << 30


def pack_bytes(files: list[bytes], manifest: dict) -> bytes:
    """A tar of numbered files and the manifest last, without times or owners, so that equal input gives equal bytes."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.GNU_FORMAT) as tar:
        named = [(f"dicom/{i:06d}.dcm", data) for i, data in enumerate(files, 1)]
        for name, data in [*named, ("manifest.json", json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode())]:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o600
            tar.addfile(info, io.BytesIO(data))
    return zstandard.ZstdCompressor(level=1, write_checksum=True).compress(raw.getvalue())


def series_archives(files: DataFrame, most: int = MOST) -> DataFrame:
    """(series_id, n_files, archive, sha256) from (series_id, number, uid, content), one archive for each series.

    Files go in order of number (null last) and uid.
    """
    large = files.groupBy("series_id").agg(F.sum(F.length("content")).alias("bytes")).filter(F.col("bytes") > most).limit(1).collect()
    if large:
        raise ValueError(f"series {large[0]['series_id']} is larger than {most} bytes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        contents = [bytes(c) for c in pdf["content"]]
        manifest = {"series_id": str(pdf["series_id"].iat[0]), "files": [{"size": len(c), "sha256": hashlib.sha256(c).hexdigest()} for c in contents]}
        packed = pack_bytes(contents, manifest)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1].astype(object), "n_files": [len(contents)], "archive": [packed], "sha256": pd.Series([hashlib.sha256(packed).hexdigest()], dtype=object).to_numpy()})

    order = Window.partitionBy("series_id").orderBy(F.col("number").asc_nulls_last(), "uid")
    numbered = files.withColumn("n", F.row_number().over(order)).select("series_id", "n", "content")
    return numbered.groupBy("series_id").applyInPandas(run, "series_id string, n_files long, archive binary, sha256 string")


def read_members(archives: DataFrame) -> DataFrame:
    """(path, member, size, sha256) of each member of archives (path, content); read as a stream, nothing is extracted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = []
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(content))) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    for m in tar:
                        if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                            raise ValueError(f"{path}: {m.name} is no plain member")
                        digest, stream = hashlib.sha256(), tar.extractfile(m)
                        while chunk := stream.read(1 << 20):
                            digest.update(chunk)
                        out.append((path, m.name, m.size, digest.hexdigest()))
                yield pd.DataFrame(out, columns=["path", "member", "size", "sha256"]).astype({"path": object, "member": object, "sha256": object})

    return archives.select("path", "content").mapInPandas(run, MEMBERS)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return read_members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.zst").load(root))
