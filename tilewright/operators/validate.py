"""Gates and contract checks: each returns rows to read, or fails the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import PATCH_UID
from tilewright.functions.vectors import is_finite, zeros_like


def finite_gate(
    df: DataFrame,
    policy: str = "threshold",
    by: list[str] | None = None,
    x: str = "x",
    max_bad: float = 0.10,
) -> DataFrame:
    """NaN/Inf policy for vectors.

    ``abort`` fails on the first bad row, ``zero`` replaces bad vectors by zeros,
    ``threshold`` replaces them unless more than ``max_bad`` of a ``by`` group is
    bad, and fails then.
    """
    good = is_finite(x)
    kind = dict(df.dtypes)[x]
    zeros = zeros_like(x)
    if policy == "zero":
        return df.withColumn(x, F.when(good, F.col(x)).otherwise(zeros))
    fail = F.raise_error(F.lit("NaN/Inf embeddings beyond the allowed share")).cast(kind)
    if policy == "abort":
        return df.withColumn(x, F.when(good, F.col(x)).otherwise(fail))
    if policy != "threshold":
        raise ValueError(f"unknown policy {policy!r}")
    keys = by or ["foundation"]
    share = df.groupBy(*keys).agg(F.avg((~good).cast("double")).alias("_bad"))
    return (
        df.join(share, keys)
        .withColumn(
            x,
            F.when(good, F.col(x)).when(F.col("_bad") <= max_bad, zeros).otherwise(fail),
        )
        .drop("_bad")
    )


def bad_share(df: DataFrame, by: list[str], x: str = "x", max_bad: float = 0.10) -> DataFrame:
    """Rows, bad rows and the verdict of the threshold policy per group."""
    bad = ~is_finite(x)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))
        .withColumn("abort", F.col("n_bad") / F.col("n_rows") > max_bad)
    )


def stable_file_filter(
    df: DataFrame,
    now: Column,
    min_age_s: float,
    mtime: str = "mtime",
    size: str = "size_bytes",
) -> DataFrame:
    """Keep non-empty files at least ``min_age_s`` old at ``now``."""
    cutoff = now - F.make_dt_interval(secs=F.lit(float(min_age_s)))
    return df.where((F.col(size) > 0) & (F.col(mtime) <= cutoff))


def validate_manifest(df: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """Violation counts of a selection manifest, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count_distinct("patch_uid")).alias("n_duplicate_uid"),
        F.count_if(~F.coalesce(F.col("label_int").isin(*classes), F.lit(False))).alias("n_bad_label"),
        F.count_if(~F.col("patch_uid").rlike(PATCH_UID)).alias("n_bad_uid"),
    ).withColumn(
        "valid",
        (F.col("n_rows") > 0)
        & (F.col("n_duplicate_uid") == 0)
        & (F.col("n_bad_label") == 0)
        & (F.col("n_bad_uid") == 0),
    )


def _model_orders(df: DataFrame, models: list[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"{m}_order").cast("long").alias("ord"))
            for m in models
        ]
    )
    return (
        df.select("label_int", F.explode(pairs).alias("p"))
        .select("label_int", "p.model", "p.ord")
        .where(F.col("ord").isNotNull())
    )


def validate_dense_order(df: DataFrame, models: list[str]) -> DataFrame:
    """Whether each ``<model>_order`` is exactly 0..N-1 over its non-null rows."""
    return (
        _model_orders(df, models)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("ord").alias("n_distinct"),
            F.min("ord").alias("lo"),
            F.max("ord").alias("hi"),
        )
        .withColumn(
            "dense",
            (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")),
        )
    )


def dense_order_class_counts(df: DataFrame, models: list[str]) -> DataFrame:
    return _model_orders(df, models).groupBy("model", "label_int").agg(F.count(F.lit(1)).alias("n"))


def validate_dims(df: DataFrame, expected: dict[str, int], x: str = "x") -> DataFrame:
    """Vector width per source against the declared width."""
    width = F.lit(None).cast("int")
    for source, dim in expected.items():
        width = F.when(F.col("foundation") == source, F.lit(dim)).otherwise(width)
    return (
        df.select("foundation", F.size(x).alias("d"), width.alias("expected"))
        .groupBy("foundation", "expected")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("d").alias("min_dim"),
            F.max("d").alias("max_dim"),
            F.count_if(~F.col("d").eqNullSafe(F.col("expected"))).alias("n_wrong"),
        )
    )


def require_classes(present: DataFrame, required: DataFrame, cls: str = "cls") -> DataFrame:
    """Every required class with a flag whether the palette covers it."""
    have = present.select(F.col(cls).alias("label")).distinct().withColumn("_p", F.lit(True))
    return required.join(have, "label", "left").select(
        "label", F.coalesce("_p", F.lit(False)).alias("present")
    )


def block_config_check(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Per source: one model key over all blocks, equal to the declared one."""
    keys = blocks.groupBy("source").agg(
        F.count_distinct("model_key").alias("n_keys"),
        F.min("model_key").alias("_lo"),
        F.count_distinct("block").alias("n_blocks"),
    )
    return keys.join(declared, "source", "left").select(
        "source",
        "n_blocks",
        "n_keys",
        F.when(F.col("n_keys") > 1, "mixed_keys")
        .when(~F.col("_lo").eqNullSafe(F.col("declared_key")), "differs_from_config")
        .otherwise("ok")
        .alias("status"),
    )


# The configuration fields that two runs into one folder must share.
MUST_MATCH = (
    "schema_version",
    "foundation",
    "hf_id",
    "model_key",
    "embedding_dim",
    "input_mode",
    "input_size",
    "pooling",
    "feature_postprocessing",
    "label_to_int",
)


def config_mismatch(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...] = MUST_MATCH) -> DataFrame:
    """Names of the must-match fields that differ between two config tables."""
    differ = [
        F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields
    ]
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(
        F.col(f"o.{key}").alias(key),
        F.concat_ws(";", *differ).alias("mismatch"),
    )


def check_predictions(pred: DataFrame, expected: DataFrame, n_classes: int = 10) -> DataFrame:
    """Output contract: coverage, duplicates and value range, as violation counts."""
    ids = expected.select(F.col("SubjectID")).groupBy("SubjectID").agg(F.count(F.lit(1)).alias("_e"))
    got = pred.groupBy("SubjectID").agg(
        F.count(F.lit(1)).alias("_p"),
        F.count_if(
            ~F.coalesce(F.col("Prediction").between(0, n_classes - 1), F.lit(False))
        ).alias("_bad"),
    )
    both = ids.join(got, "SubjectID", "full_outer")
    header = [c for c in pred.columns] == ["SubjectID", "Prediction"]
    counts = {
        "n_expected": F.coalesce(F.sum("_e"), F.lit(0)),
        "n_predicted": F.coalesce(F.sum("_p"), F.lit(0)),
        "n_missing": F.count_if(F.col("_p").isNull()),
        "n_extra": F.count_if(F.col("_e").isNull()),
        "n_duplicate": F.count_if(F.col("_p") > 1),
        "n_bad_value": F.coalesce(F.sum("_bad"), F.lit(0)),
    }
    out = both.agg(*[c.alias(n) for n, c in counts.items()])
    clean = reduce(
        lambda a, b: a & b,
        [F.col(n) == 0 for n in ("n_missing", "n_extra", "n_duplicate", "n_bad_value")],
    )
    return out.withColumn("header_ok", F.lit(header)).withColumn(
        "ok", clean & F.col("header_ok") & (F.col("n_expected") == F.col("n_predicted"))
    )
