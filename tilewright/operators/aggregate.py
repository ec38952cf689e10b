"""Grouped counts, distributions, norms and per-dimension statistics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.vectors import l2_norm, let


def cell_counts(df: DataFrame, by: tuple[str, ...] = ("patient", "label")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Counts over a fixed class list, zeros included."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    return classes.join(n, "label", "left").select(
        "label", "label_int", F.coalesce("_n", F.lit(0)).cast("long").alias("n")
    )


def class_distribution(df: DataFrame, label: str = "pred") -> DataFrame:
    """Counts and percentages of the predicted classes."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over at most one row per class
    return n.withColumn("pct", 100.0 * F.col("n") / total)


def area_pivot(
    areas: DataFrame, classes: tuple[str, ...], priority: tuple[str, ...], area: str = "area"
) -> DataFrame:
    """Per specimen: area per class, acronyms without a class, priority flag.

    ``areas`` carries ``specimen, acronym, cls`` and the area as text; records whose
    area is absent or not a number are ignored.
    """
    value = F.col(area).try_cast("double")
    used = value.isNotNull()
    per_class = [
        F.coalesce(F.sum(F.when(used & (F.col("cls") == c), value)), F.lit(0.0)).alias(c) for c in classes
    ]
    unmapped = F.collect_set(
        F.when(used & F.col("cls").isNull() & (F.length("acronym") > 0), F.col("acronym"))
    )
    out = areas.groupBy("specimen").agg(
        *per_class,
        F.array_join(F.array_sort(unmapped), ";").alias("unmapped"),
        F.coalesce(F.bool_or(used & (value > 0)), F.lit(False)).alias("any_area"),
    )
    positive = F.lit(False)
    for c in priority:
        positive = positive | (F.col(c) > 0)
    return out.withColumn("has_priority", positive)


def area_warning(pivot: DataFrame) -> DataFrame:
    """Whether more than half of the specimens have no positive area at all."""
    return pivot.agg(
        F.count(F.lit(1)).alias("n_specimens"),
        F.count_if(~F.col("any_area")).alias("n_all_zero"),
    ).withColumn("warn", F.col("n_all_zero") > F.col("n_specimens") * 0.5)


def scan_stats(
    files: DataFrame, supported: Column, committed: Column, now_s: int, min_age_s: int
) -> DataFrame:
    """Counters of one directory scan, in the order the scan decides."""
    young = (F.col("size_bytes") <= 0) | (F.lit(now_s) - F.col("mtime_s") < min_age_s)
    return files.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(young).alias("too_new_or_empty"),
        F.count_if(~young & ~supported).alias("unparseable_or_unsupported"),
        F.count_if(~young & supported).alias("parsed_supported"),
        F.count_if(~young & supported & committed).alias("already_committed"),
    )


def norm_summary(df: DataFrame, points: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """n, p05, median and p95 of all row norms per source, interpolated between ranks.

    Sketched quantiles bracket each rank, rows below a bracket are only counted, and only the
    distinct norms inside it are ordered; so neither a source nor a crowded norm meets in one task.
    """
    narrow = df.select("foundation", l2_norm("x").alias("norm")).where("norm IS NOT NULL")
    counted = narrow.groupBy("foundation", "norm").agg(F.count(F.lit(1)).alias("w"))
    slack, accuracy = 2e-5, 100_000
    edges = narrow.groupBy("foundation").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("norm", [max(p - slack, 0.0) for p in points], accuracy).alias("lo"),
        F.percentile_approx("norm", [min(p + slack, 1.0) for p in points], accuracy).alias("hi"),
    )
    one = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("p"), F.col("lo")[i].alias("lo"), F.col("hi")[i].alias("hi"))
                for i, p in enumerate(points)
            ]
        )
    )
    # rank p * (n - 1) lies between two rows, which may fall just beyond the sketch's bracket
    wanted = edges.select("foundation", "n", one.alias("e")).select(
        "foundation", "n", "e.*", (F.col("e.p") * (F.col("n") - 1)).alias("at")
    )
    tagged = counted.join(F.broadcast(wanted), "foundation")  # bounded: rows are sources x points
    below = tagged.groupBy("foundation", "p").agg(
        F.coalesce(F.sum(F.when(F.col("norm") < F.col("lo"), F.col("w"))), F.lit(0)).alias("before"),
        F.max(F.when(F.col("norm") < F.col("lo"), F.col("norm"))).alias("under"),
        F.min(F.when(F.col("norm") > F.col("hi"), F.col("norm"))).alias("over"),
    )
    inside = tagged.where((F.col("norm") >= F.col("lo")) & (F.col("norm") <= F.col("hi")))
    upto = W.partitionBy("foundation", "p").orderBy("norm").rowsBetween(W.unboundedPreceding, 0)
    placed = inside.join(F.broadcast(below), ["foundation", "p"]).withColumn("last", F.col("before") + F.sum("w").over(upto))
    first, second = F.floor("at"), F.ceil("at")
    at = lambda rank: F.min(F.when(F.col("last") > rank, F.col("norm")))
    found = placed.groupBy("foundation", "p").agg(
        F.max("n").alias("n"),
        F.max("at").alias("at"),
        F.when(F.max("before") > F.max(first), F.max("under")).otherwise(at(first)).alias("a"),
        F.coalesce(at(second), F.max("over")).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    names = ("p05", "median", "p95")
    return found.groupBy("foundation").agg(
        F.max("n").alias("n_rows"),
        *[F.max(F.when(F.col("p") == p, value)).alias(c) for p, c in zip(points, names)],
    )


def looks_unit_normed() -> Column:
    """Over a ``norm_summary`` row: are the vectors unit length?"""
    return (
        F.col("p05").between(0.95, 1.05)
        & F.col("median").between(0.98, 1.02)
        & F.col("p95").between(0.95, 1.05)
    )


def unit_norm_test(df: DataFrame) -> DataFrame:
    return norm_summary(df).select("foundation", looks_unit_normed().alias("unit_norm"))


def unit_stats(files: DataFrame, unit: str = "source_dir") -> DataFrame:
    """Per unit: patches, specimens, elapsed seconds and patches per second."""
    elapsed = (F.max("mtime_s") - F.min("mtime_s")).cast("double")
    return (
        files.groupBy(F.col(unit).alias("unit"))
        .agg(
            F.count(F.lit(1)).alias("n_patches"),
            F.count_distinct("specimen").alias("n_files"),
            elapsed.alias("elapsed_s"),
        )
        .withColumn("rate", F.col("n_patches") / F.greatest(F.col("elapsed_s"), F.lit(1e-9)))
    )


def rare_classes(df: DataFrame, quantile: float = 0.35, label: str = "label") -> DataFrame:
    """Classes whose count is at or below the quantile of the non-zero counts."""
    n = df.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cutoff = F.percentile("n", F.lit(quantile)).over(W.partitionBy())  # one row per class
    return n.withColumn("cutoff", cutoff).where(F.col("n") <= F.col("cutoff"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    over = W.partitionBy()  # one row per class
    return n.withColumn(
        "weight", F.sum("n").over(over) / (F.count(F.lit(1)).over(over) * F.col("n"))
    )


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach the balanced class weight to every row."""
    w = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(w), label)  # bounded: one row per class


def feature_moments(df: DataFrame, by: tuple[str, ...] = ("foundation",), x: str = "x") -> DataFrame:
    """Per-dimension mean and population standard deviation per group."""
    vec = array_to_vector(F.transform(x, lambda v: v.cast("double")))
    s = Summarizer.metrics("mean", "variance", "count").summary(vec)
    stats = df.groupBy(*by).agg(s.alias("s"))
    n = F.col("s.count")
    return stats.select(
        *by,
        n.alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)
        ).alias("std"),
    )


def intra_source_cosine(views: DataFrame) -> DataFrame:
    """Mean pairwise cosine distance of the views of each source patch (n >= 2).

    With unit views u_i the mean over pairs is 1 - (|sum u|^2 - n) / (n (n - 1)).
    """
    unit = let(l2_norm("x") + 1e-8, lambda n: F.transform("x", lambda v: v.cast("double") / n))
    per_source = views.groupBy("foundation", F.split("name", "#aug")[0].alias("source_name")).agg(
        Summarizer.mean(array_to_vector(unit)).alias("m"), F.count(F.lit(1)).alias("n")
    )
    n = F.col("n")
    sum_sq = n * n * F.aggregate(vector_to_array("m"), F.lit(0.0), lambda a, v: a + v * v)
    return (
        per_source.where(n >= 2)
        .withColumn("distance", 1.0 - (sum_sq - n) / (n * (n - 1)))
        .drop("m")
    )


def intra_source_summary(views: DataFrame) -> DataFrame:
    return (
        intra_source_cosine(views)
        .groupBy("foundation")
        .agg(F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("n_groups"))
    )


def orient_stain(he: Column) -> Column:
    """Both stains of a row-major 3x2 array with a positive total density, the redder one first."""
    at = lambda i: F.get(he, F.lit(i))
    sign = [F.when(at(j) + at(2 + j) + at(4 + j) < 0, -1.0).otherwise(1.0) for j in (0, 1)]
    part = [[at(2 * i + j) * sign[j] for i in range(3)] for j in (0, 1)]
    pairs = lambda a, b: F.array(*[v for i in range(3) for v in (part[a][i], part[b][i])])
    return F.when(part[0][0] < part[1][0], pairs(1, 0)).otherwise(pairs(0, 1))


def normalize_stain(he: Column, eps: float = 1e-8) -> Column:
    """Unit-length stain columns of a row-major 3x2 array."""
    at = lambda i: F.get(he, F.lit(i))
    norm = [F.sqrt(at(j) * at(j) + at(2 + j) * at(2 + j) + at(4 + j) * at(4 + j)) + eps for j in (0, 1)]
    return F.array(*[at(i) / norm[i % 2] for i in range(6)])


def slide_profile_median(profiles: DataFrame, min_patches: int = 3, min_valid: int = 3) -> DataFrame:
    """Element-wise median stain profile per slide over its valid patches.

    ``profiles`` (slide, he, maxc, valid) is the output of ``sample_per_slide`` plus
    ``stain_profiles``, so a slide has at most ``per_slide`` rows here.
    """
    ok = F.col("valid")
    medians = [
        F.median(F.when(ok, F.get("he", F.lit(i)))).alias(f"h{i}") for i in range(6)
    ] + [F.median(F.when(ok, F.get("maxc", F.lit(i)))).alias(f"m{i}") for i in range(2)]
    med = (
        profiles.groupBy("slide")
        .agg(F.count(F.lit(1)).alias("n_patches"), F.count_if(ok).alias("n_valid"), *medians)
        .where((F.col("n_patches") >= min_patches) & (F.col("n_valid") >= min_valid))
        .withColumn("he", F.array(*[F.col(f"h{i}") for i in range(6)]))
        .withColumn("he", orient_stain(F.col("he")))
    )
    return med.select(
        "slide",
        "n_patches",
        "n_valid",
        normalize_stain(F.col("he")).alias("he"),
        F.array("m0", "m1").alias("maxc"),
    )
