"""SHA-256 and HMAC as pure expressions, so that hashing stays inside code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key for HMAC-SHA-256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Lower-case hex of HMAC-SHA-256 of a text."""
    inner, outer = key_pads(key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def hmac_sql(text: str, key: bytes) -> str:
    """The same as DuckDB SQL, for checks."""
    inner, outer = (p.hex() for p in key_pads(key))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no white space; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
