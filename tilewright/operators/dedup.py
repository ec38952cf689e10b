"""Duplicate handling.  Copies of one key are pruned on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators.ranking import first_by


def consolidate_keep_last(parts: DataFrame) -> DataFrame:
    """Union of completed parts with the last write kept per (patient, slide, name)."""
    return first_by(
        parts.where("done"),
        ["patient", "slide", "name"],
        [F.desc("part_path"), F.desc("pos")],
    ).drop("part_path", "pos", "done")


def dedup_keep_first(df: DataFrame, key: str = "patch_uid", source_order: list[str] | None = None) -> DataFrame:
    """First source directory wins per key; the rest of the order makes it total.

    Directories that ``source_order`` does not name come last, by their name.
    """
    if source_order:
        place = F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source_dir"))
        rank = F.when(place > 0, place).otherwise(F.lit(len(source_order) + 1))
    else:
        rank = F.col("source_dir")
    return first_by(df, [key], [rank, F.col("source_dir"), F.col("filename"), F.col("mtime_s"), F.col("size_bytes")])


def is_first(keys: list[str]) -> Column:
    """Whether ``dedup_keep_first`` keeps the row, for plans that need the other rows as well."""
    order = ["source_dir", "filename", "mtime_s", "size_bytes"]
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1


def duplicate_counts(df: DataFrame, key: str = "patch_uid") -> DataFrame:
    """Rows, distinct keys and the duplicates that keep-first drops."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every repeated key with its count; empty means unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique_uid(df: DataFrame, keys: list[str], preview: int = 5) -> DataFrame:
    """Return ``df``, or raise with a preview of the repeated keys."""
    rows = repeated_keys(df, keys).orderBy(*keys).limit(preview).collect()
    if rows:
        raise ValueError(f"repeated keys, e.g. {[tuple(r)[:-1] for r in rows]}")
    return df
