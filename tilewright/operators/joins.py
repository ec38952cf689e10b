"""Key joins, anti joins and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01
from tilewright.functions.text import augmented_tag, label_source_tag, safe_patient, safe_slide


def join_mapping(df: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """Attach patient and slide by patch name; a miss becomes the unmapped ids."""
    m = mapping.select(
        F.col("Name").alias(name), F.col("Patient").alias("_p"), F.col("Slide").alias("_s")
    )
    return (
        df.drop("patient", "slide")
        .join(m, name, "left")
        .withColumn("patient", safe_patient("_p"))
        .withColumn("slide", safe_slide("_s"))
        .drop("_p", "_s")
    )


def align_sources(
    sources: dict[str, DataFrame], on: tuple[str, ...] = ("patient", "name"), must_overlap: bool = True
) -> DataFrame:
    """N-way inner join of the sources on their key: one ``x_<source>`` per source.

    A label that differs between sources fails the job, and so does a key that a source
    holds twice (consolidate first). Sources without a common key are an error.
    """
    names = list(sources)
    first, rest = names[0], names[1:]
    out = sources[first].withColumnRenamed("x", f"x_{first}").drop("foundation")
    for s in rest:
        side = sources[s].select(*on, F.col("x").alias(f"x_{s}"), F.col("label").alias(f"_y_{s}"))
        out = out.join(side, list(on), "inner")
    if rest:
        same = reduce(lambda a, b: a & b, [F.col("label") == F.col(f"_y_{s}") for s in rest])
        fail = F.raise_error(F.concat(F.lit("labels disagree for "), F.col(on[-1]))).cast("smallint")
        out = out.withColumn("label", F.when(same, F.col("label")).otherwise(fail))
    out = out.drop(*[f"_y_{s}" for s in rest])
    once = W.partitionBy(*on)  # the join has dealt the rows by this key, and a key has few rows
    fail = F.raise_error(F.concat(F.lit("key occurs twice in a source: "), F.col(on[-1]))).cast("smallint")
    out = out.withColumn("label", F.when(F.count(F.lit(1)).over(once) == 1, F.col("label")).otherwise(fail))
    # keys alone: no vector is shuffled for this, and the first common key ends it
    common = reduce(lambda a, b: a.join(b, list(on), "left_semi"), [d.select(*on) for d in sources.values()])
    if must_overlap and common.isEmpty():
        raise ValueError(f"no overlapping keys between {names}")
    return out


def assert_same_keys(sources: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """Per source: keys, missing keys and repeated keys against the union of all.

    One tagged union and one shuffle on the key, however many sources there are.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(F.col(key).alias("_k"), F.lit(s).alias("_s")) for s, df in sources.items()],
    )
    per_key = tagged.groupBy("_k").agg(
        *[F.count_if(F.col("_s") == s).alias(f"c_{s}") for s in sources]
    )
    report = per_key.agg(
        *[
            F.struct(
                F.lit(s).alias("source"),
                F.count_if(F.col(f"c_{s}") > 0).alias("n_keys"),
                F.count_if(F.col(f"c_{s}") == 0).alias("n_missing"),
                F.count_if(F.col(f"c_{s}") > 1).alias("n_repeated"),
            ).alias(s)
            for s in sources
        ]
    )
    return (
        report.select(F.explode(F.array(*sources)).alias("r"))
        .select("r.*")
        .withColumn("same", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0))
    )


def anti_join_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose key is already committed."""
    return df.join(done.select(*keys), keys, "left_anti")


def semi_join_targets(df: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only planned keys; place it before any Python stage."""
    return df.join(plan.select(*keys), keys, "left_semi")


def donor_theta_join(views: DataFrame, donors: DataFrame, seed: int = 42) -> DataFrame:
    """One donor per view with another patient and another class, uniform over those.

    Donors are numbered in the order (class, patient, name). What a view must not take are the
    numbers of its class and of its patient's cells, a few ranges; a number drawn from what is
    left is moved past them and joined. So no view ever meets more than its own donor.
    """
    cells = donors.groupBy("label", "patient").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("label").orderBy("patient").rowsBetween(W.unboundedPreceding, -1)
    inside = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per_class = cells.groupBy("label").agg(F.sum("n").alias("size"))
    blocks = F.broadcast(  # bounded: one row per class
        per_class.withColumn(
            "base", F.coalesce(F.sum("size").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        )
    )
    starts = inside.join(blocks, "label").withColumn("start", F.col("base") + F.col("before"))
    own = F.row_number().over(W.partitionBy("label", "patient").orderBy("name"))
    numbered = (
        donors.withColumn("_i", own)
        .join(starts.select("label", "patient", "start"), ["label", "patient"])
        .select(F.col("name").alias("donor"), (F.col("start") + F.col("_i") - 1).alias("number"))
    )
    span = lambda start, n: F.struct(start.alias("a"), (start + n).alias("e"))
    mine = starts.groupBy("patient").agg(
        F.collect_list(F.struct("label", span(F.col("start"), F.col("n")).alias("r"))).alias("_mine")
    )
    whole = blocks.select("label", span(F.col("base"), F.col("size")).alias("_block"), F.col("size").alias("_size"))
    total = donors.agg(F.count(F.lit(1)).alias("c")).scalar()
    others = F.transform(F.filter("_mine", lambda m: m["label"] != F.col("label")), lambda m: m["r"])
    barred = F.array_sort(
        F.filter(
            F.concat(F.array("_block"), F.coalesce(others, F.expr("array()"))), lambda r: r.isNotNull() & (r["e"] > r["a"])
        )
    )
    left = total - F.aggregate("_barred", F.lit(0).cast("long"), lambda s, r: s + r["e"] - r["a"])
    moved = F.aggregate(
        "_barred", F.floor(u01(seed, "view") * F.col("_left")), lambda i, r: F.when(i >= r["a"], i + r["e"] - r["a"]).otherwise(i)
    )
    fail = F.raise_error(F.concat(F.lit("no donor for "), F.col("view"))).cast("long")
    drawn = (
        views.join(mine, "patient", "left")
        .join(whole, "label", "left")
        .withColumn("_barred", barred)
        .withColumn("_left", left)
        .withColumn("number", F.when(F.col("_left") > 0, moved).otherwise(fail))
        .select(*views.columns, "number")
    )
    return drawn.join(numbered, "number", "left").drop("number")


def merge_augmented(identity: DataFrame, augmented: dict[str, DataFrame], foundation: str) -> DataFrame:
    """Identity rows plus the tagged augmented rows of slides that identity has."""
    slides = identity.select("patient", "slide").distinct()
    cols = ["patient", "slide", "name", "label", "x"]
    out = identity.select(*cols, F.lit("").alias("suffix"))
    for suffix, df in augmented.items():
        tag = augmented_tag(foundation, suffix)
        extra = df.join(slides, ["patient", "slide"], "left_semi").select(
            "patient",
            "slide",
            label_source_tag("name", F.lit(tag)).alias("name"),
            "label",
            "x",
            F.lit(suffix).alias("suffix"),
        )
        out = out.unionByName(extra)
    return out


def merge_summary(merged: DataFrame) -> DataFrame:
    """Rows and slide files per suffix of a merged table."""
    return merged.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("patient", "slide").alias("n_files"),
    )


def reuse_index_join(
    index: DataFrame,
    live: DataFrame,
    parsed: DataFrame,
    committed: DataFrame,
    classes: tuple[str, ...],
    now_s: int,
    min_age_s: int,
) -> DataFrame:
    """Status of every row of a prior index against the files that exist now.

    A path that is listed more than once counts as its latest version (then the larger one).
    """
    files = live.select("relpath", F.col("mtime_s").alias("_m"), F.col("size_bytes").alias("_z"))
    files = files.groupBy("relpath").agg(F.max(F.struct("_m", "_z")).alias("_f")).select("relpath", "_f.*")
    names = parsed.select("relpath", F.col("patch_uid").alias("_uid"), F.col("label").alias("_lab"), "mtime_s", "size_bytes")
    names = (
        names.groupBy("relpath").agg(F.max(F.struct("mtime_s", "size_bytes", "_uid", "_lab")).alias("_n")).select("relpath", "_n._uid", "_n._lab")
    )
    # the flag counts only where both uids are equal, so it is joined by the index's own, before its rows get wide
    done = committed.select("patch_uid").distinct().withColumn("_done", F.lit(True))
    return (
        index.join(done, "patch_uid", "left")
        .join(files, "relpath", "left")
        .join(names, "relpath", "left")
        .withColumn("status", _reuse_status(classes, now_s, min_age_s))
        .select(*index.columns, "status")
    )


def _reuse_status(classes: tuple[str, ...], now_s: int, min_age_s: int) -> Column:
    """From an index row and its path's latest version (_m, _z), parsed name (_uid, _lab) and committed flag (_done)."""
    return (
        F.when(~F.col("label").isin(*classes), "unsupported_label")
        .when(F.col("_m").isNull(), "missing_source")
        .when((F.col("_z") <= 0) | (F.lit(now_s) - F.col("_m") < min_age_s), "too_new_or_empty")
        .when(F.col("_uid").isNull(), "invalid")
        .when(F.col("_uid") != F.col("patch_uid"), "identity_mismatch")
        .when(F.col("_lab") != F.col("label"), "label_mismatch")
        .when(F.col("_done"), "already_committed")
        .otherwise("available")
    )


def reuse_index_rows(
    rows: DataFrame, classes: tuple[str, ...], now_s: int, min_age_s: int, home: str = "home"
) -> DataFrame:
    """``reuse_index_join`` over one table of index rows and live files; no join, and no exchange of its own if dealt by ``home``.

    ``rows``: home, relpath, patch_uid, label, mtime_s, size_bytes, in_index, committed. A live file has the uid and
    the label of its name, NULL if that does not parse, and says whether its uid is committed. An index row has
    its own uid and label. Equal paths must share their home, whose rows meet in one task; they are sorted by path there.
    """
    at = W.partitionBy(home, "relpath")
    live = ~F.col("in_index")
    file = F.struct(F.col("mtime_s").alias("_m"), F.col("size_bytes").alias("_z"))
    name = F.struct(
        "mtime_s", "size_bytes", F.col("patch_uid").alias("_uid"), F.col("label").alias("_lab"), F.col("committed").alias("_done")
    )
    return (
        rows.withColumns(
            {
                "_f": F.max(F.when(live, file)).over(at),
                "_n": F.max(F.when(live & F.col("patch_uid").isNotNull(), name)).over(at),
            }
        )
        .where("in_index")
        .select("relpath", "patch_uid", "label", "_f.*", "_n._uid", "_n._lab", "_n._done")
        .select("relpath", "patch_uid", "label", _reuse_status(classes, now_s, min_age_s).alias("status"))
    )


def reconcile_blocks(blocks: DataFrame, registry: DataFrame, model_key: str) -> DataFrame:
    """Block files against the registry: nothing or everything of a block may be
    registered; nothing means the run died between data and registry."""
    n = blocks.groupBy("model_key", "block").agg(F.count(F.lit(1)).alias("n_rows"))
    reg = registry.groupBy("model_key", "block").agg(F.count(F.lit(1)).alias("n_registered"))
    got = F.coalesce("n_registered", F.lit(0)).cast("long")
    return n.join(reg, ["model_key", "block"], "left").select(
        "model_key",
        "block",
        "n_rows",
        got.alias("n_registered"),
        F.when(F.col("model_key") != model_key, "other_model")
        .when(got == F.col("n_rows"), "ok")
        .when(got == 0, "register")
        .otherwise("partial")
        .alias("status"),
    )


def coverage_diff(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, extra or repeated in ``produced``; one shuffle."""
    both = expected.select(F.col(key), F.lit(1).alias("_e"), F.lit(0).alias("_p")).unionByName(
        produced.select(F.col(key), F.lit(0).alias("_e"), F.lit(1).alias("_p"))
    )
    issue = (
        F.when(F.col("_p") == 0, "missing").when(F.col("_e") == 0, "extra").when(F.col("_p") > 1, "duplicate")
    )
    return (
        both.groupBy(key)
        .agg(F.sum("_e").alias("_e"), F.sum("_p").alias("_p"))
        .select(key, issue.alias("issue"))
        .where(F.col("issue").isNotNull())
    )


def lookup_area_class(areas: DataFrame, palette: DataFrame) -> DataFrame:
    """Class of each area record through the acronym of its nested structure."""
    classes = palette.select(F.col("acronym").alias("_a"), "cls").distinct()
    return (
        areas.withColumn("acronym", F.col("structure.acronym"))
        .join(classes, F.col("acronym") == F.col("_a"), "left")
        .drop("_a", "structure")
    )


def literal_class(value: Column, pairs: dict[str, str]) -> Column:
    """Lookup in a fixed code table, as an expression."""
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out
