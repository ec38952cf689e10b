"""Work queues and pools: unions, differences and resume state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ranking import bottom_k


def _names(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull())


def specimen_queue(
    everything: DataFrame,
    skip: list[DataFrame],
    key: str = "specimen",
    own_completed: DataFrame | None = None,
    explicit: list[str] | None = None,
    allow: DataFrame | None = None,
    min_name: str | None = None,
    force: list[str] | None = None,
) -> DataFrame:
    """Specimens still to process.

    ``skip`` is the union of earlier runs' manifests and completed lists; ``force``
    takes names back out of it (a crashed run's last specimen), but never out of this
    run's own completed list.
    """
    out = _names(everything, key).distinct()
    if skip:
        seen = reduce(DataFrame.unionByName, [_names(s, key) for s in skip]).distinct()
        if force:
            seen = seen.where(~F.col(key).isin(*force))
        out = out.join(seen, key, "left_anti")
    if own_completed is not None:
        out = out.join(_names(own_completed, key).distinct(), key, "left_anti")
    if min_name:
        out = out.where(F.col(key) >= min_name)
    if explicit:
        out = out.where(~F.col(key).isin(*explicit))
    if allow is not None:
        out = out.join(_names(allow, key).distinct(), key, "left_semi")
    return out


def resume_progress(manifest: DataFrame, completed: DataFrame) -> DataFrame:
    """Per specimen: distinct tiles written, rows per class, and whether it is finished."""
    tiles = manifest.groupBy("specimen").agg(
        F.count_distinct("image_id", "left", "top").alias("n_tiles"),
    )
    per_class = (
        manifest.groupBy("specimen", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("specimen")  # at most one row per class from here on
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string")))), ";"
            ).alias("class_counts")
        )
    )
    done = completed.select("specimen").distinct().withColumn("completed", F.lit(True))
    return (
        tiles.join(per_class, "specimen")
        .join(done, "specimen", "full_outer")
        .select(
            "specimen",
            F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"),
            F.coalesce("class_counts", F.lit("")).alias("class_counts"),
            F.coalesce("completed", F.lit(False)).alias("completed"),
        )
    )


def normalize_suffixes(values: list[str]) -> list[str]:
    """Split on commas, trim, drop blanks and repeats, keep order."""
    tokens = [t.strip() for v in values for t in str(v).split(",")]
    out = list(dict.fromkeys(t for t in tokens if t))
    if not out:
        raise ValueError("at least one augmentation suffix is required")
    return out


def union_extras(pools: dict[str, DataFrame | None]) -> DataFrame:
    """Concatenate extra training rows; a missing pool contributes nothing."""
    cols = ["foundation", "patient", "slide", "name", "label", "x"]
    have = [df.select(*cols, F.lit(p).alias("pool")) for p, df in pools.items() if df is not None]
    if not have:
        raise ValueError("no pool given")
    return reduce(DataFrame.unionByName, have)


def cap_extras(extras: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """Uniform cap per foundation over all its pools together."""
    if cap <= 0:
        return extras
    keyed = extras.withColumn("_row_key", F.concat_ws("/", "pool", "name"))
    return bottom_k(keyed, ["foundation"], cap, "_row_key", seed, bounded=True).drop("_row_key")


def extras_summary(extras: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected (pool, foundation): found or not, rows before and after the label
    filter, slide files and rows per class."""
    per_class = (
        extras.where("label >= 0")
        .groupBy("pool", "foundation", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pool", "foundation")  # at most one row per class from here on
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("label", "n"))),
                    lambda s: F.concat_ws("=", s["label"].cast("string"), s["n"].cast("string")),
                ),
                ";",
            ).alias("per_class")
        )
    )
    rows = extras.groupBy("pool", "foundation").agg(
        F.count_distinct("patient", "slide").alias("n_slide_files"),
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(F.col("label") >= 0).alias("n_rows"),
    )
    zero = {"n_slide_files": 0, "n_before": 0, "n_rows": 0, "per_class": ""}
    return (
        expected.join(rows, ["pool", "foundation"], "left")
        .join(per_class, ["pool", "foundation"], "left")
        .withColumn("found", F.col("n_before").isNotNull())
        .fillna(zero)
        .withColumn("n_dropped", F.col("n_before") - F.col("n_rows"))
    )
