"""Feature permutations and masks: small plan-time tables, applied to vectors in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def u_value(seed, *keys) -> float:
    """Plan-time twin of ``hashing.u01``."""
    text = ":".join(str(k) for k in (seed, *keys))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def permutation(dim: int, seed, source: str) -> list[int]:
    """Fixed order of the feature positions of one source."""
    return sorted(range(dim), key=lambda i: (u_value(seed, source, i), i))


def take(x, index: list[int]) -> Column:
    """Elements of ``x`` at the given 0-based positions; the positions are one literal."""
    col = x if isinstance(x, Column) else F.col(x)
    return F.transform(F.lit(np.array(index, np.int32)), lambda i: F.get(col, i))


def permute_features(df: DataFrame, dims: dict[str, int], seed=42, x: str = "x") -> DataFrame:
    """Reorder each source's features; contiguous chunks then are random partitions."""
    out = F.col(x)
    for s, d in dims.items():
        out = F.when(F.col("foundation") == s, take(x, permutation(d, seed, s))).otherwise(out)
    return df.withColumn(x, out)


def feature_masks(
    dim: int, n_masks: int, fraction: float, min_dim: int, scheme: str, seed=42, source: str = ""
) -> list[list[int]]:
    """Feature subsets of equal width; every feature is in at least one.

    The features lie on a circle in hash order. ``balanced`` masks are arcs of it that start at
    equal distances, so neighbouring features are in equally many masks, give or take one.
    ``random`` masks hold every n-th feature of the circle and fill up with the features of the
    smallest hash for this mask. Either way the arcs or the n-th features cover all.
    """
    width = min(dim, max(min_dim, round(fraction * dim), -(-dim // n_masks)))
    if scheme not in ("random", "balanced"):
        raise ValueError(f"unknown mask scheme {scheme!r}")
    circle = permutation(dim, f"{seed}-home", source)
    masks = []
    for k in range(n_masks):
        if scheme == "balanced":
            start = k * dim // n_masks
            chosen = [circle[(start + i) % dim] for i in range(width)]
        else:
            home = circle[k::n_masks]
            others = sorted(set(range(dim)) - set(home), key=lambda i: (u_value(seed, source, k, i), i))
            chosen = home + others[: width - len(home)]
        masks.append(sorted(chosen))
    return masks


def apply_masks(df: DataFrame, masks: list[list[int]], x: str = "x") -> DataFrame:
    """One row per (row, mask) with the masked features in ``x``."""
    views = F.array(
        *[F.struct(F.lit(k).alias("mask"), take(x, m).alias("v")) for k, m in enumerate(masks)]
    )
    rest = [c for c in df.columns if c != x]
    return df.select(*rest, F.explode(views).alias("m")).select(*rest, "m.mask", F.col("m.v").alias(x))
