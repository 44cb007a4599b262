"""Encapsulated pixel data: its fragments, and the table of frame offsets that must describe them."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM, DELIMITER = (0xFFFE, 0xE000), (0xFFFE, 0xE0DD)
#: What is wrong with pixel data in fragments; the first that holds is told.
PROBLEMS = ("truncated", "no_delimiter", "not_an_item", "open_item", "odd_length", "empty")


class Damaged(ValueError):
    pass


def layout(data, start: int) -> list[tuple[int, int]]:
    """(place, end) of the basic offset table's value, each fragment's value, and the delimiter, of pixel data whose first item is at `start`.

    Only item headers are read: 8 bytes for each fragment. Ends at the delimiter, whatever follows it.
    """
    out, at, end = [], start, len(data)
    while True:
        head = data[at : at + 8]
        if len(head) < 8:
            raise Damaged("no_delimiter")
        grp, elem, size = struct.unpack("<HHI", head)
        if (grp, elem) == DELIMITER:
            return [*out, (at, at + 8)]
        if (grp, elem) != ITEM:
            raise Damaged("not_an_item")
        if size == 0xFFFFFFFF:
            raise Damaged("open_item")
        if size % 2:
            raise Damaged("odd_length")
        if out and size == 0:
            raise Damaged("empty")
        if at + 8 + size > end:
            raise Damaged("truncated")
        out.append((at + 8, at + 8 + size))
        at += 8 + size


def fragment_rows(data, start: int) -> tuple[list[tuple[int, int, int]], int, str | None]:
    """((number, offset, length) of each fragment, bytes of the basic offset table, problem).

    An offset counts from the first fragment's item, as tables of offsets do.
    """
    try:
        table, *spans, _ = layout(data, start)
    except Damaged as e:
        return [], 0, str(e)
    except ValueError:
        return [], 0, "no_delimiter"
    return [(n, s - 8 - table[1], e - s) for n, (s, e) in enumerate(spans)], table[1] - table[0], None


def offset_table_status(files: DataFrame) -> DataFrame:
    """(file, status) of files with offsets and lengths (arrays or null), frames (declared number or null), fragments (array of (number, offset,
    length)), basic (bytes of the basic offset table), problem and encapsulated.

    `absent` without a table, `valid`, or the first thing wrong. Everything is an expression over one row: files are as many as they are,
    a file's fragments lie in its own row.
    """
    offsets, lengths, found = F.col("offsets"), F.col("lengths"), F.col("fragments")
    n = F.size(offsets)
    later = F.slice(offsets, 2, F.greatest(n - 1, F.lit(0)))
    rising = F.forall(F.zip_with(F.slice(offsets, 1, F.greatest(n - 1, F.lit(0))), later, lambda a, b: a < b), lambda x: x)
    pairs = F.arrays_zip(offsets.alias("o"), lengths.alias("l"), found.alias("f"))
    padded = lambda x: x + x % 2
    declared = F.coalesce("frames", F.lit(1))
    checks: list[tuple[Column, str]] = [
        (offsets.isNull() & lengths.isNull(), "absent"),
        (offsets.isNull() | lengths.isNull(), "half_a_table"),
        ((n == 0) | (n != F.size(lengths)), "uneven_table"),
        ((F.get(offsets, F.lit(0)) != 0) | ~rising, "not_rising"),
        (F.exists(lengths, lambda x: x <= 0), "empty_frame"),
        ((declared <= 0) | (declared != n), "frame_count"),
        (~F.col("encapsulated"), "not_encapsulated"),
        (F.col("problem").isNotNull(), "fragments"),
        (F.col("basic") != 0, "basic_table"),
        (F.size(found) > n, "fragment_not_listed"),
        (F.size(found) < n, "fragment_missing"),
        (F.exists(pairs, lambda p: p.o != p.f.offset), "offset_elsewhere"),
        (F.exists(pairs, lambda p: padded(p.l) != p.f.length), "length_differs"),
    ]
    status = F.when(*[checks[0][0], F.lit(checks[0][1])])
    for when, name in checks[1:]:
        status = status.when(F.coalesce(when, F.lit(False)), name)
    return files.withColumn("status", F.when(F.col("problem").isNotNull() & offsets.isNotNull() & lengths.isNotNull() & F.col("encapsulated"), F.concat(F.lit("fragments:"), "problem")).otherwise(status.otherwise("valid"))).select("file", "status")
