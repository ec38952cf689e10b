"""Row-local vector expressions over ARRAY<FLOAT> / ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Without it Catalyst copies the value into every use, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a, b) -> Column:
    """Inner product, accumulated in double."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def l2_norm(x) -> Column:
    return F.sqrt(
        F.aggregate(
            _col(x), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
        )
    )


def l2_normalize(x) -> Column:
    """Unit-length copy; an all-zero vector stays zero."""
    x = _col(x)
    return let(
        l2_norm(x),
        lambda norm: F.when(
            norm > 0, F.transform(x, lambda v: (v.cast("double") / norm).cast("float"))
        ).otherwise(x),
    )


def is_finite(x) -> Column:
    """True when no element is NaN or infinite."""
    return ~F.exists(_col(x), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def zeros_like(x) -> Column:
    return F.transform(_col(x), lambda v: F.lit(0.0).cast("float"))


def chunk_bounds(dim: int, size: int, min_dim: int = 16) -> list[tuple[int, int]]:
    """[start, stop) slices of ``size``; a tail shorter than ``min_dim`` is dropped.

    A vector too short for any slice is kept whole.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    cuts = [(s, min(s + size, dim)) for s in range(0, dim, size)]
    kept = [(s, e) for s, e in cuts if e - s >= min_dim]
    return kept or ([(0, dim)] if dim > 0 else [])


def chunk_slices(df: DataFrame, x: str = "x", size: int = 768, min_dim: int = 16) -> DataFrame:
    """One row per slice of ``x``: adds ``start``, ``stop`` and ``chunk``."""
    d = F.size(x)
    starts = F.sequence(F.lit(0), d - 1, F.lit(size))
    cuts = F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(s + size, d).alias("stop")),
    )
    kept = F.filter(cuts, lambda c: c["stop"] - c["start"] >= min_dim)
    whole = F.array(F.struct(F.lit(0).alias("start"), d.alias("stop")))
    return (
        df.where(d > 0)
        .withColumn("_cut", F.explode(F.when(F.size(kept) > 0, kept).otherwise(whole)))
        .withColumn("start", F.col("_cut.start"))
        .withColumn("stop", F.col("_cut.stop"))
        .withColumn("chunk", F.slice(F.col(x), F.col("start") + 1, F.col("stop") - F.col("start")))
        .drop("_cut")
    )


def concat_sources(columns: dict[str, str]) -> Column:
    """L2-normalise each source vector and concatenate in source-name order."""
    return F.concat(*[l2_normalize(columns[name]) for name in sorted(columns)])


def element_mean(vectors) -> Column:
    """Element-wise mean of ARRAY<ARRAY<FLOAT>>, in double."""
    vs = _col(vectors)
    zero = F.transform(F.get(vs, F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate(
        vs, zero, lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q.cast("double"))
    )
    return F.transform(total, lambda v: v / F.size(vs))


def pool_crops(crops, how: str, normalize: bool = True) -> Column:
    """Combine per-crop vectors: ``percrop`` keeps them, ``mean`` and ``concat`` pool."""
    if how == "percrop":
        return _col(crops)
    if how == "mean":
        pooled = F.transform(element_mean(crops), lambda v: v.cast("float"))
    elif how == "concat":
        pooled = F.flatten(_col(crops))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return l2_normalize(pooled) if normalize else pooled
