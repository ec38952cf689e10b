"""Per-class thresholds by coordinate search on macro F1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.schema import N_CLASSES


def threshold_grid(size: int) -> list[float]:
    return [float(v) for v in np.linspace(0.05, 2.0, size)]


def candidate_counts(
    scored: DataFrame, thresholds: list[float], c: int, grid: list[float], proba: str = "proba"
) -> DataFrame:
    """(y, other, wins, n): everything the candidates of class ``c`` depend on.

    With the other thresholds fixed, a row is predicted ``c`` or its best other class.
    As p_c / t falls with t, ``c`` wins for a prefix of the ascending grid, so the
    prefix length replaces one prediction per candidate, and rows collapse to at most
    classes x classes x (grid + 1) counts before the shuffle.
    """
    t = [max(v, 1e-6) for v in thresholds]
    others = F.array(
        *[
            F.struct((F.get(proba, F.lit(k)) / t[k]).alias("s"), F.lit(-k).alias("k"))
            for k in range(N_CLASSES)
            if k != c
        ]
    )
    best = F.array_max(others)
    wins = F.size(
        F.filter(
            F.array(*[F.lit(max(g, 1e-6)) for g in grid]),
            lambda g: (F.col("_p") / g > F.col("_best.s"))
            | ((F.col("_p") / g == F.col("_best.s")) & (F.lit(c) < -F.col("_best.k"))),
        )
    )
    return (
        scored.select("y", F.get(proba, F.lit(c)).alias("_p"), best.alias("_best"))
        .select("y", (-F.col("_best.k")).alias("other"), wins.alias("wins"))
        .groupBy("y", "other", "wins")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _macro_f1(conf: np.ndarray, all_labels: bool) -> float:
    tp = np.diag(conf)
    both = conf.sum(axis=0) + conf.sum(axis=1)
    f1 = np.where(both > 0, 2.0 * tp / np.maximum(both, 1), 0.0)
    used = np.ones(len(f1), dtype=bool) if all_labels else both > 0
    return float(f1[used].mean()) if used.any() else 0.0


def candidate_f1(rows, c: int, n_grid: int, all_labels: bool = False) -> list[float]:
    """Macro F1 of every grid candidate from the rows of ``candidate_counts``."""
    out = []
    for i in range(n_grid):
        conf = np.zeros((N_CLASSES, N_CLASSES))
        for y, other, wins, n in rows:
            conf[y, c if wins > i else other] += n
        out.append(_macro_f1(conf, all_labels))
    return out


def tune_thresholds(
    scored: DataFrame,
    grid_size: int = 11,
    passes: int = 1,
    proba: str = "proba",
    all_labels: bool = False,
) -> list[float]:
    """Greedy search: classes in order, candidates in grid order, a candidate is taken
    only when it beats the best score so far by more than 1e-12.

    One job per class over the persisted calibration rows; what returns to the driver
    is the bounded count table.
    """
    grid = threshold_grid(grid_size)
    scored = scored.select("y", proba).persist()
    try:
        t = [1.0] * N_CLASSES
        start = [tuple(r) for r in candidate_counts(scored, t, 0, [1.0], proba).collect()]
        best = candidate_f1(start, 0, 1, all_labels)[0]
        for _ in range(passes):
            improved = False
            for c in range(N_CLASSES):
                rows = [tuple(r) for r in candidate_counts(scored, t, c, grid, proba).collect()]
                for g, score in zip(grid, candidate_f1(rows, c, len(grid), all_labels)):
                    if score > best + 1e-12:
                        best, t[c], improved = score, g, True
            if not improved:
                break
        return t
    finally:
        scored.unpersist()
