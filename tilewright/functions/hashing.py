"""Deterministic uniforms: every sampler orders rows by a hash of their key.

``u`` depends on the seed and the key alone, so a sample does not change with
row order, batch size or partitioning, and a retried task redraws the same
values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash32(seed, *keys) -> Column:
    """First 32 bits of md5(seed:key:...), as a long."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])
    # Never NULL; saying so keeps Catalyst from adding null checks that hash again.
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))


def u01(seed, *keys) -> Column:
    """Uniform in [0, 1) from (seed, keys)."""
    return hash32(seed, *keys).cast("double") / F.lit(TWO32)


def mix32(h: np.ndarray) -> np.ndarray:
    """Murmur3 finaliser over uint32 values (avalanche of all bits)."""
    h = h.astype(np.uint32, copy=True)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h
