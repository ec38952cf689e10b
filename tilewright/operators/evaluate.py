"""Metrics over confusion counts and grouped scores, summaries and rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.ranking import rank_in_group
from tilewright.schema import N_CLASSES

RUN = ("config_id", "fold")


def argmax(p) -> Column:
    """Index of the largest element; the lowest index wins ties."""
    p = p if isinstance(p, Column) else F.col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confusion(df: DataFrame, by: tuple[str, ...] = RUN) -> DataFrame:
    """(run, y, pred) counts: the only pass over the rows."""
    return df.groupBy(*by, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_table(conf: DataFrame, by: tuple[str, ...] = RUN, n_classes: int = N_CLASSES) -> DataFrame:
    """Per run and class: tp, support (true), predicted, and the run total."""
    ids = F.explode(F.array(*[F.lit(c) for c in range(n_classes)])).alias("cls")
    per_class = conf.select(*by, "y", "pred", "n", ids)
    y, p, c = F.col("y"), F.col("pred"), F.col("cls")
    return per_class.groupBy(*by, "cls").agg(
        F.sum(F.when((y == c) & (p == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(y == c, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(p == c, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum("n").alias("total"),
    )


def _f1() -> Column:
    both = F.col("support") + F.col("predicted")
    return F.when(both > 0, 2.0 * F.col("tp") / both).otherwise(0.0)


def per_class_f1(conf: DataFrame, by: tuple[str, ...] = RUN) -> DataFrame:
    """F1 for every class, 0 where it is undefined."""
    return class_table(conf, by).select(*by, "cls", _f1().alias("f1"))


def metrics_multiclass(conf: DataFrame, by: tuple[str, ...] = RUN, all_labels: bool = False) -> DataFrame:
    """MCC, macro recall, macro F1 and accuracy per run.

    Macro means run over the classes seen in truth or prediction, or over all classes
    with ``all_labels``.
    """
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    used = F.lit(True) if all_labels else seen
    s, p, t = F.col("support").cast("double"), F.col("predicted").cast("double"), F.col("total").cast("double")
    recall = F.when(s > 0, F.col("tp") / s).otherwise(0.0)
    sums = class_table(conf, by).groupBy(*by).agg(
        F.max(t).alias("_n"),
        F.sum("tp").cast("double").alias("_c"),
        F.sum(s * p).alias("_sp"),
        F.sum(s * s).alias("_ss"),
        F.sum(p * p).alias("_pp"),
        F.avg(F.when(used, recall)).alias("recall"),
        F.avg(F.when(used, _f1())).alias("f1"),
    )
    n2 = F.col("_n") * F.col("_n")
    den = F.sqrt((n2 - F.col("_pp")) * (n2 - F.col("_ss")))
    mcc = F.when(den > 0, (F.col("_c") * F.col("_n") - F.col("_sp")) / den).otherwise(0.0)
    return sums.select(
        *by,
        mcc.alias("mcc"),
        "recall",
        "f1",
        (F.col("_c") / F.col("_n")).alias("accuracy"),
    )


def weighted_specificity(conf: DataFrame, by: tuple[str, ...] = RUN) -> DataFrame:
    """Support-weighted TN / (TN + FP)."""
    neg = F.col("total") - F.col("support")
    tn = neg - (F.col("predicted") - F.col("tp"))
    spec = tn / F.greatest(neg, F.lit(1))
    return class_table(conf, by).groupBy(*by).agg(
        (F.sum(spec * F.col("support")) / F.sum("support")).alias("specificity")
    )


def _score_bucket(s: Column, buckets: int) -> Column:
    """Grows with the score; fine near 0 and near 1."""
    to_zero = F.floor(F.log2(F.greatest(s, F.lit(1e-300))) * buckets)
    to_one = -F.ceil(F.log2(F.greatest(1.0 - s, F.lit(1e-17))) * buckets)
    return F.when(s < 0.5, to_zero).otherwise(to_one).cast("int")


def _score_counts(df: DataFrame, by: tuple[str, ...], proba: str, buckets: int) -> DataFrame:
    """(run, cls, _b, s, pos, neg), each score once for an Arrow batch, class and run.

    Counted before anything is exploded, so a batch never becomes rows x classes rows on their way out.
    """
    rows = df.select(*by, "y", F.col(proba).cast("array<double>").alias("_p"))
    fields = [rows.schema[c] for c in by]
    kinds = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("cls", T.IntegerType()), ("s", T.DoubleType()), ("pos", T.LongType()), ("neg", T.LongType())))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table["_p"].combine_chunks()
            rows_of = pc.list_parent_indices(lists).to_numpy()
            if not len(rows_of):
                continue
            first = np.searchsorted(rows_of, np.arange(len(lists)))
            cls = np.arange(len(rows_of)) - first[rows_of]
            known = pc.is_valid(table["y"]).to_numpy()[rows_of]  # unlabelled rows neither win nor lose
            y = table["y"].fill_null(-1).to_numpy()
            hit = (y[rows_of] == cls) & known
            flat = pa.table(
                {
                    **{c: table[c].take(pa.array(rows_of)) for c in by},
                    "cls": pa.array(cls, pa.int32()),
                    "s": lists.flatten(),
                    "pos": pa.array(hit.astype(np.int64)),
                    "neg": pa.array((known & ~hit).astype(np.int64)),
                }
            )
            got = flat.group_by([*by, "cls", "s"]).aggregate([("pos", "sum"), ("neg", "sum")])
            got = got.rename_columns([n.removesuffix("_sum") for n in got.column_names])
            yield from got.select([*by, "cls", "s", "pos", "neg"]).combine_chunks().to_batches()

    return rows.mapInArrow(count, kinds).withColumn("_b", _score_bucket(F.col("s"), buckets))


def weighted_auroc(
    df: DataFrame, by: tuple[str, ...] = RUN, proba: str = "proba", buckets: int = 1024
) -> DataFrame:
    """Support-weighted one-vs-rest rank AUC; one-class columns are skipped.

    Rows are first counted per distinct score, in Arrow batches and again after the one large
    shuffle, which deals out the score buckets; a score on which many rows agree arrives as a count.
    Wins inside a bucket and wins over all earlier buckets add up, so no task orders a whole class and
    only bucket totals are ever accumulated along a class.  Buckets have equal relative width towards 0
    and towards 1 (``buckets`` for each halving), so scores that crowd at either end spread.
    """
    key = [*by, "cls"]
    score = (
        _score_counts(df, by, proba, buckets)
        .repartition(*key, "_b")
        .groupBy(*key, "_b", "s")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    inside = W.partitionBy(*key, "_b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    local = score.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    bucket = local.groupBy(*key, "_b").agg(
        F.sum("pos").cast("double").alias("pos"),
        F.sum("neg").cast("double").alias("neg"),
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)).alias("wins"),
    )
    upto = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per_class = (
        bucket.withColumn("_below", F.coalesce(F.sum("neg").over(upto), F.lit(0.0)))
        .groupBy(*key)
        .agg(
            F.sum("pos").alias("p"),
            F.sum("neg").alias("n"),
            F.sum(F.col("wins") + F.col("pos") * F.col("_below")).alias("wins"),
        )
    )
    ok = (F.col("p") > 0) & (F.col("n") > 0)
    auc = F.col("wins") / (F.col("p") * F.col("n"))
    return per_class.groupBy(*by).agg(
        (F.sum(F.when(ok, auc * F.col("p"))) / F.sum(F.when(ok, F.col("p")))).alias("auroc")
    )


def all_metrics(df: DataFrame, by: tuple[str, ...] = RUN, proba: str = "proba") -> DataFrame:
    """The six run metrics from rows (run, y, proba)."""
    conf = confusion(df.withColumn("pred", argmax(proba)), by)
    return (
        metrics_multiclass(conf, by)
        .join(weighted_specificity(conf, by), list(by))
        .join(weighted_auroc(df, by, proba), list(by))
    )


def fold_summary(metrics: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    out = []
    for m in names:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *out)


def rank_configs(results: DataFrame, buckets: int = 65_536) -> DataFrame:
    """Rank by the mean of f1, mcc and recall (NULL if one is missing), then by the
    six metrics; missing values last."""
    mean = (F.col("f1") + F.col("mcc") + F.col("recall")) / 3.0
    order = ["mean_metric", "f1", "mcc", "recall", "specificity", "auroc", "accuracy"]
    # Coarse order: means lie in [-1, 1]; missing means form the last bucket.
    coarse = F.coalesce(F.floor((1.0 - F.col("mean_metric")) / 2.0 * buckets), F.lit(buckets + 1)).cast("int")
    return rank_in_group(
        results.withColumn("mean_metric", mean),
        [],
        coarse,
        [F.col(c).desc_nulls_last() for c in order] + [F.col("config_id")],
        out="rank",
    )


def compare_predictions(left: DataFrame, right: DataFrame, key: str = "name", proba: str = "proba") -> DataFrame:
    """Agreement of two posterior tables over the same keys."""
    both = left.select(key, F.col(proba).alias("_l")).join(right.select(key, F.col(proba).alias("_r")), key)
    diff = F.zip_with("_l", "_r", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    row = both.select(
        (argmax("_l") != argmax("_r")).alias("flip"),
        F.aggregate(diff, F.lit(0.0), lambda a, v: a + v).alias("sum_diff"),
        F.array_max(diff).alias("max_diff"),
        F.size(diff).alias("width"),
    )
    return row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("flip").alias("n_flips"),
        (1.0 - F.avg(F.col("flip").cast("double"))).alias("agreement"),
        (F.sum("sum_diff") / F.sum("width")).alias("mean_abs_diff"),
        F.max("max_diff").alias("max_abs_diff"),
        F.count_if(F.col("max_diff") > 1e-6).alias("n_rows_changed"),
    )
