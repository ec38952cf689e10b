"""Augmentation planning: scarce cells, local targets, copies and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01


def scarce_cells(df: DataFrame, threshold: int) -> DataFrame:
    """(patient, class) cells with fewer than ``threshold`` rows."""
    return (
        df.groupBy("patient", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < threshold)
    )


def plan_scarce_cells(df: DataFrame, threshold: int, donor_min: int) -> DataFrame:
    """Role of every cell: ``target``, ``donor``, both or neither."""
    n = F.col("n")
    return (
        df.groupBy("patient", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("patient", "label", "n", (n < threshold).alias("is_target"), (n >= donor_min).alias("is_donor"))
    )


def scarce_sources(df: DataFrame, threshold: int) -> DataFrame:
    """Rows to augment, each with its cell count."""
    return df.join(scarce_cells(df, threshold), ["patient", "label"])


def plan_local(df: DataFrame, alpha: float, policy: str, cap: int, floor: int) -> DataFrame:
    """(patient, slide, class) counts with the slide's target and a source flag.

    The target is ``ceil(alpha * max or median class count)`` of the slide, capped; a
    class is a source when its count is at least ``floor`` and below the target.
    """
    if policy not in ("max", "median"):
        raise ValueError(f"unknown target policy {policy!r}")
    slide = W.partitionBy("patient", "slide")  # at most one row per class
    ref = F.max("n").over(slide) if policy == "max" else F.median("n").over(slide)
    return (
        df.groupBy("patient", "slide", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("target", F.least(F.lit(cap), F.ceil(ref * F.lit(float(alpha)))).cast("long"))
        .withColumn("is_source", (F.col("n") >= floor) & (F.col("n") < F.col("target")))
    )


def local_sources(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the plan's source cells with count and target."""
    cells = plan.where("is_source").select("patient", "slide", "label", "n", "target")
    return df.join(cells, ["patient", "slide", "label"])


def copies_per_patch(n, target, lo: int, hi: int, u: Column) -> Column:
    """Copies that lift a cell of ``n`` rows to ``target``, rounded by the uniform ``u``."""
    n = n if isinstance(n, Column) else F.col(n)
    target = target if isinstance(target, Column) else F.lit(target)
    per = F.greatest((target - n) / n, F.lit(0.0))
    drawn = F.floor(per) + (u < per - F.floor(per)).cast("int")
    return F.when(n <= 0, lo).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), drawn))).cast("int")


def geometry(seed, key: str, j: str) -> Column:
    """Move of view ``j``: one of the 7 non-identity flips and turns, each used once
    before any repeats; the numbers are those of ``stain.SYMMETRIES``."""
    turn = F.floor(F.col(j) / 7)
    deck = F.array_sort(
        F.array(*[F.struct(u01(seed, key, turn, F.lit(m)).alias("u"), F.lit(m).alias("m")) for m in range(1, 8)])
    )
    return F.get(deck, (F.col(j) % 7).cast("int"))["m"]


def expand_views(sources: DataFrame, copies: str = "copies", seed=42, key: str = "name") -> DataFrame:
    """One row per view: ``view`` is key#augJ, ``geom`` its move."""
    return (
        sources.where(F.col(copies) > 0)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .withColumn("view", F.concat(F.col(key), F.lit("#aug"), F.col("j").cast("string")))
        .withColumn("geom", geometry(seed, key, "j"))
    )


def plan_summary(sources: DataFrame, cell: list[str], copies: str = "copies") -> DataFrame:
    """Dry run: cells, source patches and expected views; without a source no cells, no patches and unknown views."""
    per_cell = sources.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(copies).alias("_v")
    )
    return per_cell.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_sources"),
        F.sum("_v").alias("n_views"),
    )
