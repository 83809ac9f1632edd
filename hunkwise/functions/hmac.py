"""HMAC-SHA256 from built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 64


def hmac_sha256_hex(secret: str | bytes, body: Column) -> Column:
    """Hex digest of HMAC-SHA256(secret, body). Only the two key pads are made on the driver."""
    key = secret.encode("utf-8") if isinstance(secret, str) else secret
    if len(key) > BLOCK_BYTES:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK_BYTES, b"\0")
    inner_pad, outer_pad = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), body), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)
