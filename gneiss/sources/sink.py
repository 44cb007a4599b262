"""Series archives of any size: members stream from their files through tar and zstd into place, with constant memory.

A series' files come to one task in order of their rows, never their bytes: the task opens each file in turn. An archive is written
beside its place and renamed when it is whole, so a lost executor leaves a part file at most, and the task that runs again writes the same bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVES = "series_id string, archive string, n_files long, bytes long, archive_bytes long, sha256 string"
CHUNK = 1 << 20
# Most files and bytes of a series.
MOST_FILES, MOST_BYTES = 500_000, 64 << 30
# End of fixed values.


class Counted:
    """A stream that counts and digests what passes through it."""

    def __init__(self, stream):
        self.stream, self.bytes, self.digest = stream, 0, hashlib.sha256()

    def read(self, n: int = CHUNK) -> bytes:
        data = self.stream.read(n)
        self.bytes += len(data)
        self.digest.update(data)
        return data

    def write(self, data) -> int:
        self.stream.write(data)
        self.bytes += len(data)
        self.digest.update(data)
        return len(data)


def stream_archive(series_id: str, members: Iterator[tuple[Callable, int]], out) -> tuple[int, int, int, str]:
    """(files, bytes, bytes of the archive, its digest); members are (open, size) in order, out a stream that is written to.

    Members are numbered and have neither times nor owners; a manifest of their sizes and digests comes last. A file that is not as long as
    it was said to be ends the archive with an error. Held at a time: one chunk, and a line of the manifest for each file.
    """
    whole, listed, total = Counted(out), [], 0
    with zstandard.ZstdCompressor(level=1, write_checksum=True).stream_writer(whole, closefd=False) as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.GNU_FORMAT, bufsize=CHUNK) as tar:
        for number, (open_, size) in enumerate(members, 1):
            total += size
            if number > MOST_FILES or total > MOST_BYTES:
                raise ValueError(f"series {series_id} is larger than a series may be")
            info = tarfile.TarInfo(f"dicom/{number:06d}.dcm")
            info.size, info.mode = size, 0o600
            with open_() as file:
                source = Counted(file)
                try:
                    tar.addfile(info, source)
                except OSError as e:
                    raise ValueError(f"file {number} of series {series_id} is shorter than {size} bytes") from e
                if file.read(1):
                    raise ValueError(f"file {number} of series {series_id} is longer than {size} bytes")
            listed.append({"sha256": source.digest.hexdigest(), "size": size})
        manifest = json.dumps({"files": listed, "series_id": series_id}, sort_keys=True, separators=(",", ":")).encode()
        info = tarfile.TarInfo("manifest.json")
        info.size, info.mode = len(manifest), 0o600
        tar.addfile(info, io.BytesIO(manifest))
    return len(listed), total, whole.bytes, whole.digest.hexdigest()


def store_of(path: str):
    """(file system, path in it) by Arrow, for local paths and URIs."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


def write_archives(files: DataFrame, root: str) -> DataFrame:
    """One row of ARCHIVES for each series of files (series_id, number, uid, path, size), its archive written below root.

    Files go in order of number (null last), uid and path. Nothing is written before the result is asked for; asking twice writes the same bytes again.
    A series' id names its file, so it must be letters, digits, points, dashes and underscores.
    """
    columns = ["series_id", "path", "size"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in columns)))
        store, base = store_of(root)
        store.create_dir(base, recursive=True)
        row = next(rows, None)
        while row is not None:
            series = row[0]
            if not re.fullmatch(r"[A-Za-z0-9._-]+", series or "") or series.startswith("."):
                raise ValueError(f"{series!r} cannot name an archive")

            def members() -> Iterator[tuple[Callable, int]]:
                nonlocal row
                while row is not None and row[0] == series:  # noqa: B023
                    source, at = store_of(row[1])
                    yield (lambda: source.open_input_stream(at)), row[2]  # noqa: B023
                    row = next(rows, None)

            final, part = f"{base}/{series}.tar.zst", f"{base}/.{series}.{uuid.uuid4().hex}.part"
            try:
                with store.open_output_stream(part) as out:
                    made = stream_archive(series, members(), out)
                store.move(part, final)
            except BaseException:
                if store.get_file_info(part).is_file:
                    store.delete_file(part)
                raise
            yield pd.DataFrame([(series, f"{root}/{series}.tar.zst", *made)], columns=["series_id", "archive", "n_files", "bytes", "archive_bytes", "sha256"])

    order = ["series_id", F.col("number").asc_nulls_last(), "uid", "path"]
    slim = files.select("series_id", "number", "uid", "path", F.col("size").cast("long").alias("size")).repartition("series_id").sortWithinPartitions(*order)
    return slim.select(*columns).mapInPandas(run, ARCHIVES)
