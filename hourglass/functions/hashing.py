"""Deterministic, engine-portable hashing.

The first 8 hex digits of ``md5("{id}:{seed}")`` read as an unsigned 32-bit
number.  Every SQL engine with ``md5`` can reproduce it, which makes splits and
draws checkable against an independent oracle, and it does not depend on the
partitioning, so re-running a task after an executor loss gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0  # 2**32


def hash_u32(key, seed) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(k.cast("string"), F.lit(":"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key, seed) -> Column:
    """Uniform in [0, 1) from :func:`hash_u32`."""
    return hash_u32(key, seed) / F.lit(HASH_RANGE)
