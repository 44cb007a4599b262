"""Headers of Part 10 files as a Spark data source that reads ranges of files, never pixel data.

    spark.dataSource.register(Part10Source)
    spark.read.format("part10").load(root)                            # one row for each header element, with its subtree
    spark.read.format("part10").option("rows", "fragments").load(root)  # where pixel data lies, and its fragments

Partitions are batches of files. A file is read from its start in ranges that double; what no row needs (long binary values, fragments)
is passed over by its length. So a file of any size costs at most twice its header and one least range.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.sources import fragments, part10

TREE = "path string, ordinal int, depth int, item_path array<string>, grp int, elem int, vr string, values array<string>, creator string, last int, items int, error string"
FRAGMENTS = "path string, start long, length long, sha256 string, basic long, fragments array<struct<number:int,offset:long,length:long>>, bytes_read long, error string"
#: Bytes of the first range and of one after a jump, files and bytes (of whole files) of a partition.
LEAST, JUMP, FILES, BYTES = 4096, 64, 500, 64 << 30


class Ranged:
    """A file as slices: bytes come in ranges that double as reading goes on, from LEAST; after a jump from JUMP again.

    `read` counts the bytes that have been read.
    """

    def __init__(self, file, size: int):
        self.file, self.size, self.read, self.at, self.held, self.step = file, size, 0, 0, b"", LEAST

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> bytes:
        start, stop = span.start or 0, min(self.size, self.size if span.stop is None else span.stop)
        if start < self.at or start > self.at + len(self.held):  # what lies between is not read
            self.at, self.held, self.step = start, b"", JUMP
        if stop > self.at + len(self.held):
            have = self.held[start - self.at :]
            self.file.seek(start + len(have))
            more = self.file.read(min(max(stop - start - len(have), self.step), self.size - start - len(have)))
            self.read += len(more)
            self.at, self.held, self.step = start, have + more, 2 * self.step
        return self.held[start - self.at : stop - self.at]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def listing(root: str) -> Iterator[tuple[str, int]]:
    """(path, size) of all files below a folder, or of a file, by Arrow's file systems (local, object stores, HDFS)."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    info = store.get_file_info(base)
    found = store.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File:
            yield f.path, f.size


class Part10Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or json.loads(options["paths"])[0]
        self.rows = options.get("rows", "elements")
        self.digest = options.get("digest", "false").lower() == "true"
        self.files, self.bytes = int(options.get("files", FILES)), int(options.get("bytes", BYTES))

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, n in listing(self.root):
            if out[-1].paths and (len(out[-1].paths) >= self.files or size + n > self.bytes):
                out.append(Files([]))
                size = 0
            out[-1].paths.append((path, n))
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        for path, size in partition.paths:
            with store.open_input_file(path) as file:
                data = Ranged(file, size)
                usual = path.rpartition(".")[2].lower() in ("dcm", "dicom", "ima")
                if usual or data[128:132] == b"DICM":
                    yield from self.layout(path, data) if self.rows == "fragments" else self.elements(path, data)

    def elements(self, path: str, data: Ranged) -> Iterator[tuple]:
        try:
            rows = part10.tree(data)
        except (part10.Broken, struct.error) as e:
            yield path, 0, 0, [], None, None, None, [], None, None, None, str(e)
            return
        for n, (depth, items, grp, elem, vr, values, creator, last, count) in enumerate(rows):
            yield path, n, depth, items, grp, elem, vr, values, creator, last, count, None

    def layout(self, path: str, data: Ranged) -> Iterator[tuple]:
        import hashlib

        try:
            pixels = [e for e in part10.walk(data) if e[0] == "pixels"]
        except (part10.Broken, struct.error) as e:
            yield path, None, None, None, None, None, data.read, str(e)
            return
        if not pixels:
            yield path, None, None, None, None, None, data.read, "no_pixels"
            return
        _, _, start, length = pixels[0]
        found, basic, problem = (None, None, None)
        if length == 0xFFFFFFFF:
            found, basic, problem = fragments.fragment_rows(data, start)
            length = None if problem else fragments.layout(data, start)[-1][1] - start
        elif start + length > len(data):
            problem = "truncated"
        read, sha = data.read, None
        if self.digest and problem is None:
            digest, at = hashlib.sha256(), start
            data.file.seek(start)
            while at < start + length:
                part = data.file.read(min(1 << 20, start + length - at))
                digest.update(part)
                at += len(part)
            sha = digest.hexdigest()
        yield path, start, length, sha, basic, found, read, problem


class Part10Source(DataSource):
    """Options: rows (elements or fragments), digest (of the pixel data's bytes, for fragments), files and bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "part10"

    def schema(self) -> str:
        return FRAGMENTS if self.options.get("rows") == "fragments" else TREE

    def reader(self, schema) -> Part10Reader:
        return Part10Reader(dict(self.options))
