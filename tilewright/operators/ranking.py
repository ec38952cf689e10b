"""Exact ranks and bottom-k inside groups that may hold most of the table.

A plain ``row_number() over (partition by class order by u)`` sends a whole
class through one task.  Here the order is split in two: ``coarse``, an integer
that grows with the order, and ``fine``, which settles rows of equal coarse
value.  A count per (group, coarse) - partially aggregated before its shuffle -
says where the cut falls, so only rows at or below the cut are ever sorted, and
they are sorted per (group, coarse) piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01

BUCKETS = 16384


def hash_bucket(u: Column, buckets: int = BUCKETS) -> Column:
    """Coarse order of a uniform: equal-width, hence evenly filled."""
    return F.floor(u * buckets).cast("int")


def _maybe_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    # ``bounded`` is the caller's statement that the group set cannot grow with
    # the data (label classes); otherwise the join strategy is left to AQE.
    return F.broadcast(df) if bounded else df


def _by(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def piece_counts(df: DataFrame, by: list[str], coarse: Column) -> DataFrame:
    """(group, _piece, _n, _before): rows per piece and rows in all earlier pieces."""
    upto = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return (
        df.select(*by, coarse.alias("_piece"))
        .groupBy(*by, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    )


def rank_in_group(
    df: DataFrame,
    by: list[str],
    coarse: Column,
    fine: list[Column],
    out: str = "rank",
    bounded: bool = False,
) -> DataFrame:
    """1-based exact rank by (coarse, fine) in each group, for every row."""
    df, keys = _by(df, by)
    tagged = df.withColumn("_piece", coarse)
    pieces = piece_counts(tagged, keys, F.col("_piece")).select(*keys, "_piece", "_before")
    inside = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*fine))
    ranked = (
        tagged.join(_maybe_broadcast(pieces, bounded), [*keys, "_piece"])
        .withColumn(out, F.col("_before") + inside)
        .drop("_piece", "_before")
    )
    return ranked if by else ranked.drop("_all")


def take_lowest(
    df: DataFrame,
    by: list[str],
    k: int | DataFrame,
    coarse: Column,
    fine: list[Column],
    bounded: bool = False,
    out: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group by (coarse, fine).

    ``k`` is one number, or a quota table (group columns, ``k``); groups without
    a quota row yield nothing.  ``out`` names an optional column with the rank.
    """
    bounded = bounded or not by
    df, keys = _by(df, by)
    tagged = df.withColumn("_piece", coarse)
    pieces = piece_counts(tagged, keys, F.col("_piece"))
    if isinstance(k, DataFrame):
        quota = k.select(*keys, F.col("k").cast("long").alias("_k"))
        pieces = pieces.join(_maybe_broadcast(quota, bounded), keys)
    else:
        pieces = pieces.withColumn("_k", F.lit(int(k)))
    reached = pieces.where(F.col("_before") < F.col("_k"))
    inside = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*fine))
    if bounded and not out:
        # _before grows with _piece, so all three maxima belong to the cut piece.
        cut = reached.groupBy(*keys).agg(
            F.max("_piece").alias("_cut"),
            F.max("_before").alias("_before"),
            F.max("_k").alias("_k"),
        )
        kept = (
            tagged.join(F.broadcast(cut), keys)
            .where(F.col("_piece") <= F.col("_cut"))
            .withColumn("_r", inside)
            .where(
                (F.col("_piece") < F.col("_cut"))
                | (F.col("_r") <= F.col("_k") - F.col("_before"))
            )
            .drop("_piece", "_cut", "_before", "_k", "_r")
        )
    else:
        # Joined on the piece as well, so that a dominant group spreads over its pieces.
        offsets = reached.select(*keys, "_piece", "_before", "_k")
        rank = out or "_r"
        kept = (
            tagged.join(_maybe_broadcast(offsets, bounded), [*keys, "_piece"])
            .withColumn(rank, F.col("_before") + inside)
            .where(F.col(rank) <= F.col("_k"))
            .drop("_piece", "_before", "_k", *([] if out else ["_r"]))
        )
    return kept if by else kept.drop("_all")


def bottom_k(
    df: DataFrame,
    by: list[str],
    k: int | DataFrame,
    key: str,
    seed,
    bounded: bool = False,
    buckets: int = BUCKETS,
    out: str | None = None,
) -> DataFrame:
    """Uniform sample without replacement: the k smallest (u(seed, key), key).

    ``bounded`` declares few groups of any size (classes, sources): the cut is found from
    piece counts. Otherwise there are many groups of which none is large (specimens, slides),
    and one window per group does; Spark prunes it to ``k`` rows in every map task. A quota
    table always takes the first way.
    """
    if by and not bounded and isinstance(k, int):
        order = [F.col("_u"), F.col(key)]
        return first_by(df.withColumn("_u", u01(seed, key)), by, order, k, out=out).drop("_u")
    tagged = df.withColumn("_u", u01(seed, key))
    kept = take_lowest(
        tagged,
        by,
        k,
        hash_bucket(F.col("_u"), buckets),
        [F.col("_u"), F.col(key)],
        bounded=bounded,
        out=out,
    )
    return kept.drop("_u")


def first_by(
    df: DataFrame, by: list[str], order: list[Column], k: int = 1, out: str | None = None
) -> DataFrame:
    """First ``k`` rows per key, with their rank as ``out`` if asked for.

    Spark prunes each map task to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a key with very many copies stays cheap.
    """
    rank = out or "_rn"
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    kept = df.withColumn(rank, rn).where(F.col(rank) <= k)
    return kept if out else kept.drop(rank)
