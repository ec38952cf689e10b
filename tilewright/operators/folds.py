"""Stratified group folds by one distributed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import hash32
from tilewright.operators.ranking import rank_in_group

PIECES, PARTS = 1024, 256


def fold_table(df: DataFrame, k: int, group: str = "patient", forced: tuple[str, ...] = ()) -> DataFrame:
    """(group, fold): every eligible group in one of ``k`` folds, forced groups in -1.

    A group's stratum is its most frequent class (the lowest of equal ones). Groups lie in the
    order of their stratum, then of their size, the largest first, then of their hash, and are dealt
    out there and back: 0, 1, .., k-1, k-1, .., 0. So folds differ by one group at most, in all and
    by two in a stratum. The same rule holds for any number of groups.
    """
    if k < 2:
        raise ValueError("need at least two folds")
    counts = df.where("label >= 0").groupBy(group, "label").agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy(group).agg(
        F.sum("c").alias("n"), F.max_by("label", F.struct("c", -F.col("label"))).alias("stratum")
    )
    is_forced = F.col(group).isin(*forced) if forced else F.lit(False)
    eligible = groups.where(~is_forced)
    n_groups = eligible.count()
    if n_groups < 2:
        raise ValueError(f"need at least two groups for folds, found {n_groups}")
    k = min(k, n_groups)
    # descending sizes as pieces: exact up to PIECES rows and cut into PARTS by the hash that orders groups of
    # equal size, so many small groups share no task; then one piece for each binary order
    exact = F.lit(0) - F.least(F.col("n"), F.lit(PIECES))
    piece = F.when(F.col("n") <= PIECES, exact).otherwise(-PIECES - F.floor(F.log2("n")))
    drawn = hash32("fold", group)
    part = F.when(F.col("n") <= PIECES, F.floor(drawn / F.lit(2**32 // PARTS))).otherwise(0)
    ranked = rank_in_group(
        eligible,
        [],
        ((F.col("stratum").cast("long") * 2 * PIECES + piece) * PARTS + part).cast("long"),
        [F.desc("n"), drawn, F.col(group)],
        out="_r",
    )
    at = F.pmod(F.col("_r") - 1, F.lit(2 * k))
    there = F.when(at < k, at).otherwise(2 * k - 1 - at)
    placed = ranked.select(group, there.cast("int").alias("fold"))
    return placed.unionByName(groups.where(is_forced).select(group, F.lit(-1).alias("fold")))


def group_kfold(df: DataFrame, k: int = 5, group: str = "patient", forced: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``fold``; -1 marks rows that belong to every training side."""
    return df.where("label >= 0").join(fold_table(df, k, group, forced), group)
