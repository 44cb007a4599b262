"""The vendor block "SV10" as a map from tag name to values."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed limits of the block: tags, items of a tag, bytes.
TAGS, ITEMS, BYTES = 128, 4096, 16 << 20


def parse(data: bytes | None) -> dict[str, list[str]] | None:
    """Tag names to non-empty values; null if the block is broken or beyond its limits."""
    if data is None or len(data) < 16 or len(data) > BYTES or data[:4] != b"SV10":
        return None
    n, at, found = struct.unpack_from("<I", data, 8)[0], 16, {}
    if not 0 < n <= TAGS:
        return None
    try:
        for _ in range(n):
            name = data[at : at + 64].split(b"\0")[0].decode("latin-1")
            items = struct.unpack_from("<I", data, at + 76)[0]
            at += 84
            if items > ITEMS:
                return None
            values = []
            for _ in range(items):
                size = struct.unpack_from("<I", data, at + 4)[0]
                at += 16
                if at + size > len(data):
                    return None
                value = data[at : at + size].split(b"\0")[0].decode("latin-1").strip()
                at += (size + 3) // 4 * 4
                if value:
                    values.append(value)
            found[name] = values
    except struct.error:
        return None
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def csa_values(blocks: pd.Series) -> pd.Series:
    return pd.Series([parse(None if b is None else bytes(b)) for b in blocks], dtype=object)
