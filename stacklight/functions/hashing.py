"""Digests and keyed references from built-in sha2 alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(value: Column, secret: str) -> Column:
    """HMAC-SHA256 of a string, as lower-case hex."""
    import hashlib

    key = secret.encode()
    if not key:
        raise ValueError("the secret is empty")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def patron_reference(patron_id: Column, secret: str) -> Column:
    """The pseudonym of a patron: 32 hex characters, the same for one secret."""
    return F.left(hmac_sha256(patron_id.cast("string"), secret), F.lit(32))


def flat_hash(*fields: Column) -> Column:
    """sha256 over fields joined by the unit separator; nulls as empty, arrays joined by bars by the caller."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)
