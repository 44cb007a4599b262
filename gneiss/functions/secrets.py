"""Sealed values bound to their row. Keys are parameters; nothing here keeps or logs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seal(key: Column, value: Column, nonce: Column, row: Column) -> Column:
    """AES-GCM of the value, bound to the row's id, as "v1.nonce.text"; the nonce (12 bytes) must never repeat."""
    sealed = F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.encode(row, "UTF-8"))
    return F.concat_ws(".", F.lit("v1"), F.base64(nonce), F.base64(F.substr(sealed, F.lit(13))))


def unseal(key: Column, text: Column, row: Column) -> Column:
    """The value, or null if it was sealed for another row, by another key, or changed."""
    parts = F.split(text, r"\.")
    sealed = F.concat(F.unbase64(parts[1]), F.unbase64(parts[2]))
    return F.when(parts[0] == "v1", F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(row, "UTF-8")).cast("string"))
