"""Sizes, tolerances and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
#: Fixed values of the upload contract: least part, parts of an object at most.
LEAST_PART, MOST_PARTS = 64 * MIB, 10_000
#: Fixed times of the state machine, in seconds: receipt lease, provisional retention, delay of publication.
LEASE, RETENTION, DELAY = 600, 90 * 86_400, 7 * 86_400


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b) if b & (b - 1) else F.shiftright(a + (b - 1), b.bit_length() - 1)


def part_size(size: Column) -> Column:
    """Bytes of a part: the size over MOST_PARTS, rounded up to whole MiB, and LEAST_PART at least."""
    each = F.expr("1") * F.ceil(size.cast("decimal(20,0)") / MOST_PARTS).cast("long")
    return F.greatest(F.lit(LEAST_PART).cast("long"), ceil_div(each, MIB) * MIB)


def part_count(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(size.cast("decimal(20,0)") / part_size(size)).cast("long"))


def last_part(size: Column) -> Column:
    return size - (part_count(size) - 1) * part_size(size)


def floats_agree(a: Column, b: Column, absolute: float = 1.0, relative: float = 1e-3) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def is_unit_vector(v: Column) -> Column:
    """Components within 1.1 of zero and a squared length of 0.5 to 1.5."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.forall(v, lambda x: F.abs(x.cast("double")) <= 1.1) & square.between(0.5, 1.5)


def retry_delay_ms(attempt: Column, asked: Column) -> Column:
    """250 ms doubled each attempt, not under what the server asks, of which 30 s count at most."""
    return F.greatest(F.expr("250L") * F.pow(F.lit(2), attempt).cast("long"), F.least(F.coalesce(asked, F.lit(0)), F.lit(30_000)).cast("long"))


def pixel_bytes(rows: Column, columns: Column, samples: Column, frames: Column, bits: Column) -> Column:
    """Bytes of uncompressed pixels, padded to an even number."""
    raw = F.expr("1L") * rows * columns * samples * frames * F.shiftright(bits, 3)
    return raw + raw % 2


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
