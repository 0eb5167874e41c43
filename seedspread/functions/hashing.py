"""Deterministic pseudo-random order keys.

A random draw of the reference (NumPy generator) cannot be reproduced by Spark,
so every random order here is ``ORDER BY md5('<seed>:<salt><id>'), id``.  The same
key is easy to write in any SQL dialect, which is what the oracle queries do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKET_BITS = 16


def order_key(id_col: str | Column, seed: int, salt: str = "") -> Column:
    """Hex md5 of ``'<seed>:<salt><id>'``; ties are broken by the id itself."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:{salt}"), c.cast("string")))


def hash_bucket(key: str | Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """Leading ``bits`` of a hex key as an int: non-decreasing in the key's sort order."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(c, 1, bits // 4), 16, 10).cast("int")
