"""Pixel tables: tissue checks and the two-phase tile scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01
from tilewright.operators.ontology import is_raster, packed, unpack
from tilewright.operators.ranking import hash_bucket, rank_in_group
from tilewright.session import materialize

# Inverse of the published haematoxylin-eosin-DAB matrix
# ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78)); its eosin column.
EOSIN = (-1.00767869, 1.13473037, -0.48041419)


def eosin(r, g, b) -> Column:
    """Eosin concentration of a pixel by colour deconvolution."""
    logs = [F.log(F.greatest(F.col(c) / 255.0, F.lit(1e-6))) / F.log(F.lit(1e-6)) for c in (r, g, b)]
    return F.greatest(sum(v * F.lit(k) for v, k in zip(logs, EOSIN)), F.lit(0.0))


def tissue_qc(
    pixels: DataFrame,
    bg_max: float = 0.60,
    lowsat_max: float = 0.95,
    eosin_max: float = 0.80,
    eosin_level: float = 50.0,
) -> DataFrame:
    """Background, saturation and eosin shares per tile, and the verdict.

    The eosin scale is the tile's own minimum-to-maximum range. Tiles with an ``rgb`` column are
    checked in place, without a shuffle; of pixel rows, colours are counted per tile first, so
    later steps see each colour once.
    """
    if is_raster(pixels):
        shares = raster_shares(pixels, eosin_level)
    else:
        shares = _pixel_shares(pixels, eosin_level)
    verdict = (
        F.when(F.col("bg_frac") > bg_max, "background")
        .when(F.col("lowsat_frac") > lowsat_max, "low_saturation")
        .when(F.col("eosin_low_frac") > eosin_max, "low_eosin")
        .otherwise("ok")
    )
    return shares.withColumn("verdict", verdict)


def raster_shares(tiles: DataFrame, eosin_level: float) -> DataFrame:
    """Background, low saturation and low eosin shares of each tile, from its own bytes; a tile
    without pixels has no row."""
    kept = tiles.select("tile_id", "rgb").where("length(rgb) > 0")
    kind = kept.schema["tile_id"].dataType.simpleString()

    def shares(rgb: bytes) -> tuple[float, float, float]:
        codes, n = np.unique(packed(rgb), return_counts=True)
        px = unpack(codes)
        hi, lo = px.max(axis=1), px.min(axis=1)
        sat = np.divide(hi - lo, hi, out=np.zeros(len(px)), where=hi > 0)
        logs = np.log(np.maximum(px / 255.0, 1e-6)) / np.log(1e-6)
        e = np.maximum(logs[:, 0] * EOSIN[0] + logs[:, 1] * EOSIN[1] + logs[:, 2] * EOSIN[2], 0.0)
        level = (e - e.min()) / (e.max() - e.min() + 1e-8) * 255.0
        tests = ((lo > 230) | (hi < 25), sat < 0.05, level < eosin_level)
        return tuple(float(n[t].sum() / n.sum()) for t in tests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([shares(v) for v in pdf["rgb"]], columns=["bg_frac", "lowsat_frac", "eosin_low_frac"])
            yield pd.concat([pdf[["tile_id"]].reset_index(drop=True), out], axis=1)

    return kept.mapInPandas(run, f"tile_id {kind}, bg_frac double, lowsat_frac double, eosin_low_frac double")


def _pixel_shares(pixels: DataFrame, eosin_level: float) -> DataFrame:
    """As ``raster_shares``, from one row for each pixel."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    colors = (
        pixels.groupBy("tile_id", "r", "g", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bg", ((r > 230) & (g > 230) & (b > 230)) | ((r < 25) & (g < 25) & (b < 25)))
        .withColumn("sat", F.when(hi > 0, (hi - lo) / hi).otherwise(0.0))
        .withColumn("e", eosin("r", "g", "b"))
    )
    span = colors.groupBy("tile_id").agg(F.min("e").alias("e0"), F.max("e").alias("e1"))
    level = (F.col("e") - F.col("e0")) / (F.col("e1") - F.col("e0") + 1e-8) * 255.0

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")

    return (
        colors.join(span, "tile_id")
        .groupBy("tile_id")
        .agg(
            share(F.col("bg")).alias("bg_frac"),
            share(F.col("sat") < 0.05).alias("lowsat_frac"),
            share(level < eosin_level).alias("eosin_low_frac"),
        )
    )


def two_phase_scan(
    labelled: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    cap: int,
    seed: int = 42,
    key: str = "tile_id",
    margin: float = 1.5,
) -> DataFrame:
    """First ``cap`` tiles per (specimen, class) that pass the costly check.

    ``labelled`` (specimen, label, key) comes from the cheap pass.  Tiles are ranked once
    in hash order; ``check`` (tiles -> passing tiles) runs on a prefix of each group, and
    again on the next, doubled prefix only for groups that are still short.  The result
    equals checking every tile, while full groups are never fetched further.
    """
    group = ["specimen", "label"]
    u = u01(seed, key)
    ranked = materialize(
        rank_in_group(
            labelled.where("label IS NOT NULL"), group, hash_bucket(u), [u, F.col(key)], out="_rank"
        ),
        "ranked-tiles",
    )
    sizes = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    lo, hi = 0, max(1, int(cap * margin))
    open_groups, passed = sizes, None
    while True:
        todo = ranked.join(open_groups.select(*group), group, "left_semi").where(
            (F.col("_rank") > lo) & (F.col("_rank") <= hi)
        )
        ok = materialize(todo.join(check(todo).select(key), key, "left_semi"), "passed-tiles")
        passed = ok if passed is None else passed.unionByName(ok)
        have = passed.groupBy(*group).agg(F.count(F.lit(1)).alias("_have"))
        open_groups = materialize(
            sizes.join(have, group, "left").where(
                (F.coalesce("_have", F.lit(0)) < cap) & (F.col("_size") > hi)
            ),
            "open-groups",
        )
        if open_groups.isEmpty():
            break
        lo, hi = hi, hi * 2
    return rank_in_group(passed.drop("_rank"), group, hash_bucket(u), [u, F.col(key)], out="_rank").where(
        F.col("_rank") <= cap
    ).drop("_rank")
