"""Stable keys, the commit registry and the experiment registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01
from tilewright.operators.ranking import first_by, hash_bucket, rank_in_group


def surrogate_keys(keys: DataFrame, dictionary: DataFrame | None, key: str, id_col: str) -> DataFrame:
    """The dictionary with an id for every key: known ids stay, new keys follow the maximum.

    New ids are dense in hash order, ranked per hash bucket and never in one task.
    """
    new = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if dictionary is not None:
        new = new.join(dictionary.select(key), key, "left_anti")
        top = dictionary.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    else:
        top = F.lit(0)
    u = u01("id", key)
    ranked = rank_in_group(new, [], hash_bucket(u), [u, F.col(key)], out="_r")
    fresh = ranked.select(key, (top + F.col("_r")).cast("long").alias(id_col))
    return fresh if dictionary is None else dictionary.select(key, id_col).unionByName(fresh)


def registry_conflicts(registry: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are repeated in the batch or already registered."""
    inside = (
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("repeated", F.col("n") > 1)
    )
    known = registry.select(*keys).distinct().withColumn("registered", F.lit(True))
    return (
        inside.join(known, keys, "left")
        .withColumn("registered", F.coalesce("registered", F.lit(False)))
        .where(F.col("repeated") | F.col("registered"))
        .drop("n")
    )


def registry_insert(registry: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All or nothing: the registry plus the batch, or an error naming a few conflicts."""
    bad = registry_conflicts(registry, batch, keys).limit(5).collect()  # at most five rows
    if bad:
        raise ValueError(f"duplicate registry keys, nothing inserted: {[tuple(r) for r in bad]}")
    return registry.unionByName(batch)


def registry_upsert(registry: DataFrame, batch: DataFrame, key: str = "config_id") -> DataFrame:
    """Rows of the batch replace rows with the same key."""
    both = registry.withColumn("_v", F.lit(0)).unionByName(batch.withColumn("_v", F.lit(1)))
    return first_by(both, [key], [F.desc("_v")]).drop("_v")


def skip_completed(
    configs: DataFrame, registry: DataFrame, overwrite: bool = False, key: str = "config_id"
) -> DataFrame:
    """Configurations still to run: completed ones are skipped unless overwriting."""
    if overwrite:
        return configs
    done = registry.where("status = 'completed'").select(key).distinct()
    return configs.join(done, key, "left_anti")


def oof_store(rows: DataFrame) -> DataFrame:
    """Validation rows only, sorted by patch id inside each configuration's partition."""
    return (
        rows.where("fold >= 0")
        .select("config_id", "patch_id", "patient_id", "fold", "y", "proba")
        .repartitionByRange("config_id", "patch_id")
        .sortWithinPartitions("config_id", "patch_id")
    )


def write_oof(rows: DataFrame, path: str) -> None:
    oof_store(rows).write.mode("overwrite").partitionBy("config_id").parquet(path)
