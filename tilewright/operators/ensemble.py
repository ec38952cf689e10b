"""Fitting and applying the whole ensemble; out-of-fold runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.vectors import l2_normalize
from tilewright.operators import evaluate as E
from tilewright.operators import heads as H
from tilewright.operators.aggregate import feature_moments, norm_summary, rare_classes
from tilewright.operators.aggregate import looks_unit_normed
from tilewright.operators.calibrate import tune_thresholds
from tilewright.operators.joins import align_sources
from tilewright.operators.sample import cap_per_class, stratified_split
from tilewright.schema import N_CLASSES
from tilewright.session import materialize


def match_representation(extra: DataFrame, home: DataFrame, mode: str = "auto") -> DataFrame:
    """L2-normalise foreign vectors when the home source is unit length.

    ``auto`` decides per source from the home norms, ``l2`` always, ``none`` never.
    """
    if mode == "none":
        return extra
    if mode == "l2":
        return extra.withColumn("x", l2_normalize("x"))
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    unit = norm_summary(home).select("foundation", looks_unit_normed().alias("_unit"))
    return (
        extra.join(F.broadcast(unit), "foundation", "left")  # bounded: one row per source
        .withColumn("x", F.when(F.col("_unit"), l2_normalize("x")).otherwise(F.col("x")))
        .drop("_unit")
    )


def fold_transform(df: DataFrame, kind: str, fit_on: Column, x: str = "x") -> DataFrame:
    """``none``, ``l2`` or ``standard`` per source; the scaler sees ``fit_on`` rows only."""
    if kind == "none":
        return df
    if kind == "l2":
        return df.withColumn(x, l2_normalize(x))
    if kind != "standard":
        raise ValueError(f"unknown transform {kind!r}")
    m = feature_moments(df.where(fit_on)).select("foundation", F.arrays_zip("mean", "std").alias("_ms"))
    scaled = F.zip_with(
        x,
        "_ms",
        lambda v, s: (
            (v.cast("double") - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0)
        ).cast("float"),
    )
    # bounded: one row of moments per source
    return df.join(F.broadcast(m), "foundation").withColumn(x, scaled).drop("_ms")


@dataclass
class EnsembleModel:
    """Heads plus the decision rule."""

    bank: H.Bank
    thresholds: list[float] = field(default_factory=lambda: [1.0] * N_CLASSES)
    rare: list[int] = field(default_factory=list)
    boost: float = 1.10
    how: str = "source_mean"
    weights: dict[str, float] = field(default_factory=dict)

    def raw(self, x_cols: dict[str, str], **tta) -> Column:
        return H.ensemble_proba(self.bank, x_cols, self.how, self.weights, **tta)

    def decide(self, raw) -> Column:
        """Rare boost, thresholds, renormalise: applied once, after any averaging."""
        return H.apply_thresholds(H.rare_boost(raw, self.rare, self.boost), self.thresholds)

    def predict(self, aligned: DataFrame, x_cols: dict[str, str], **tta) -> DataFrame:
        return (
            aligned.withColumn("raw", self.raw(x_cols, **tta))
            .withColumn("proba", self.decide("raw"))
            .withColumn("pred", E.argmax("proba"))
        )


FITTERS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "ridge": H.fit_ridge_heads,
    "logistic": H.fit_logistic_heads,
    "lda": lambda df, size, min_dim: H.fit_shrinkage_lda(df, size=size),
}


def ensemble_fit(
    base: dict[str, DataFrame],
    extras: DataFrame | None = None,
    size: int = 768,
    min_dim: int = 16,
    cap: int = 0,
    calibration: float = 0.10,
    grid_size: int = 11,
    passes: int = 1,
    boost: float = 1.10,
    rare_quantile: float = 0.35,
    kinds: tuple[str | Callable[[DataFrame, int, int], DataFrame], ...] = ("ridge",),
    how: str = "source_mean",
    seed: int = 42,
    key: str = "name",
) -> EnsembleModel:
    """Split aligned base rows, fit heads per source, calibrate on base rows.

    Extra rows join the fit side of their source only: rare classes, the split and the
    thresholds never see them.  ``kinds`` names fitters or holds own ones: functions of the fit rows
    (foundation, label, x), the chunk size and the least width that return a head table.
    """
    sources = sorted(base)
    aligned = align_sources({s: base[s] for s in sources})
    keys = aligned.select(key, "label")
    rare = [int(r["label"]) for r in rare_classes(keys, rare_quantile).collect()]  # <= classes
    roles = stratified_split(cap_per_class(keys, cap, seed, key), calibration, seed, key).persist()
    try:
        fit_keys = roles.where("role = 'fit'").select(key)
        fit = reduce(
            DataFrame.unionByName,
            [
                base[s]
                .join(fit_keys, key, "left_semi")
                .select(F.lit(s).alias("foundation"), "label", "x")
                for s in sources
            ],
        )
        if extras is not None:
            fit = fit.unionByName(extras.where("label >= 0").select("foundation", "label", "x"))
        fit = fit.persist()
        chosen = [k if callable(k) else FITTERS[k] for k in kinds]
        heads = reduce(DataFrame.unionByName, [f(fit, size, min_dim) for f in chosen])
        model = EnsembleModel(H.head_bank(heads), rare=rare, boost=boost, how=how)
        fit.unpersist()
        cal = aligned.join(roles.where("role = 'cal'").select(key), key, "left_semi")
        raw = cal.select(F.col("label").cast("int").alias("y"), model.raw({s: f"x_{s}" for s in sources}).alias("raw"))
        scored = raw.select("y", H.rare_boost("raw", rare, boost).alias("proba"))
        if roles.where("role = 'cal'").limit(1).count():
            model.thresholds = tune_thresholds(scored, grid_size, passes)
        return model
    finally:
        roles.unpersist()


BY_FOLD: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "ridge": H.ridge_heads_by_fold,
    "lda": lambda df, size, min_dim: H.lda_heads_by_fold(df, size=size),
}


def oof_one_pass(
    base: dict[str, DataFrame],
    folds: DataFrame,
    transform: str = "none",
    group: str = "patient",
    key: str = "name",
    kinds: tuple[str, ...] = ("ridge",),
    size: int = 768,
    min_dim: int = 16,
    boost: float = 1.10,
    rare_quantile: float = 0.35,
    how: str = "source_mean",
) -> DataFrame:
    """``oof_run`` without calibration, from one scan for each kind of head whatever the number of folds.

    Only ``none`` and ``l2`` are taken: a scaler that sees the training side changes the vectors of each fold.
    The aligned rows are written once; every fold's rows are scored with the heads that have not seen them.
    """
    if transform not in ("none", "l2"):
        raise ValueError(f"{transform!r} depends on the fold; use oof_run")
    sources = sorted(base)
    moved = {s: fold_transform(base[s], transform, F.lit(True)) for s in sources}
    aligned = materialize(align_sources(moved).where("label >= 0").join(folds, group), "oof-aligned")
    rows = reduce(DataFrame.unionByName, [aligned.select(F.lit(s).alias("foundation"), "label", F.col(f"x_{s}").alias("x"), "fold") for s in sources])
    heads = materialize(reduce(DataFrame.unionByName, [BY_FOLD[k](rows, size, min_dim) for k in kinds]), "oof-heads")
    out = []
    for (k,) in aligned.where("fold >= 0").select("fold").distinct().orderBy("fold").collect():  # one row per fold
        rare = [int(r["label"]) for r in rare_classes(aligned.where(F.col("fold") != k).select(key, "label"), rare_quantile).collect()]
        model = EnsembleModel(H.head_bank(heads.where(F.col("fold") == k).drop("fold")), rare=rare, boost=boost, how=how)
        scored = model.predict(aligned.where(F.col("fold") == k), {s: f"x_{s}" for s in sources})
        out.append(scored.select(key, group, F.lit(int(k)).alias("fold"), F.col("label").cast("int").alias("y"), "proba"))
    return reduce(DataFrame.unionByName, out)


def oof_run(
    base: dict[str, DataFrame],
    folds: DataFrame,
    transform: str = "none",
    group: str = "patient",
    extras: DataFrame | None = None,
    key: str = "name",
    **fit_args,
) -> DataFrame:
    """Out-of-fold rows (name, patient, fold, y, proba): one fit per fold.

    ``folds`` is the (group, fold) table.  Scalers and heads see the training side of
    each fold; extra rows are transformed with it and join the fit.
    """
    k_folds = [r[0] for r in folds.where("fold >= 0").select("fold").distinct().orderBy("fold").collect()]
    sources = sorted(base)
    placed = {s: base[s].join(folds, group) for s in sources}
    out = []
    for k in k_folds:
        side: dict[str, DataFrame] = {}
        more = []
        for s in sources:
            rows = placed[s].withColumn("_extra", F.lit(False))
            if extras is not None:
                foreign = extras.where(F.col("foundation") == s).select(
                    *[c for c in rows.columns if c not in ("fold", "_extra")],
                    F.lit(-2).alias("fold"),
                    F.lit(True).alias("_extra"),
                )
                rows = rows.unionByName(foreign)
            rows = fold_transform(rows, transform, (F.col("fold") != k) & ~F.col("_extra"))
            side[s] = rows.where(~F.col("_extra")).drop("_extra")
            more.append(rows.where("_extra").select("foundation", "label", "x"))
        extra = reduce(DataFrame.unionByName, more) if extras is not None else None
        train = {s: d.where(F.col("fold") != k).drop("fold") for s, d in side.items()}
        valid = {s: d.where(F.col("fold") == k).drop("fold") for s, d in side.items()}
        model = ensemble_fit(train, extra, key=key, **fit_args)
        scored = model.predict(align_sources(valid), {s: f"x_{s}" for s in sources})
        out.append(
            scored.select(
                key, group, F.lit(int(k)).alias("fold"), F.col("label").cast("int").alias("y"), "proba"
            )
        )
    return reduce(DataFrame.unionByName, out)
