"""Samplers and quotas: hash-ordered, exact, and safe for dominant groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import u01
from tilewright.operators.ranking import (
    bottom_k,
    first_by,
    hash_bucket,
    piece_counts,
    rank_in_group,
    take_lowest,
)


def sample_first_n(scan: DataFrame, n: int, shard: str = "shard", pos: str = "pos") -> DataFrame:
    """First ``n`` samples in shard order."""
    return scan.orderBy(shard, pos).limit(n)


def round_robin_select(df: DataFrame, quota: int, seed: int = 42, key: str = "patch_uid") -> DataFrame:
    """Diversity first: one patch per specimen per round until the class quota is met.

    Round r holds the r-th patch of every specimen in hash order.  Only ``quota``
    patches per specimen can matter; the last round is cut by the specimens' hash.
    """
    per_specimen = bottom_k(df, ["label", "specimen"], quota, key, seed, out="round")
    order = u01(f"{seed}-specimen", "specimen")
    per_specimen = per_specimen.withColumn("round", F.col("round").cast("long"))
    return take_lowest(
        per_specimen,
        ["label"],
        quota,
        F.col("round").cast("int"),
        [order, F.col("specimen")],
        bounded=True,
    )


def round_robin_report(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Per class: specimens available, specimens touched, rows selected."""
    have = df.groupBy("label").agg(F.count_distinct("specimen").alias("n_specimens"))
    took = selected.groupBy("label").agg(
        F.count_distinct("specimen").alias("n_touched"), F.count(F.lit(1)).alias("n_selected")
    )
    return have.join(took, "label", "left").fillna(0)


def reservoir_per_class(df: DataFrame, capacity: int | DataFrame, seed: int = 42, key: str = "patch_uid") -> DataFrame:
    """Uniform sample of at most ``capacity`` rows per class; a table gives one per class."""
    return bottom_k(df, ["label"], capacity, key, seed, bounded=True)


def quota_plan(
    counts: DataFrame,
    target: int | None = None,
    add: int | None = None,
    buffer_ratio: float = 0.03,
    spare_limit: int | None = None,
) -> DataFrame:
    """Rows needed per class and the candidate capacity that covers rare failures.

    ``spare_limit`` bounds what is added to the need; without it the ratio alone decides.
    """
    if (target is None) == (add is None):
        raise ValueError("give exactly one of target and add")
    need = F.lit(int(add)) if target is None else F.greatest(F.lit(int(target)) - F.col("n"), F.lit(0))
    spare = F.greatest(F.lit(4), F.ceil(F.col("need") * F.lit(float(buffer_ratio))))
    capacity = F.col("need") + (spare if spare_limit is None else F.least(spare, F.lit(int(spare_limit))))
    return counts.withColumn("need", need.cast("long")).withColumn(
        "capacity", F.when(F.col("need") <= 0, 0).otherwise(capacity).cast("long")
    )


def interleave_by_class(df: DataFrame, classes: DataFrame, seed: int = 42, key: str = "patch_uid") -> DataFrame:
    """Round-robin stream over classes: adds ``round`` and the exact ``position``.

    The position follows from the class sizes: all earlier rounds of every class plus
    the earlier classes of this round.
    """
    sized = (
        classes.join(df.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left")
        .fillna(0, ["n"])
        .select("label", "position", "n")
    )
    sizes = sized.agg(F.sort_array(F.collect_list(F.struct("position", "n")))).scalar()
    u = u01(seed, key)
    ranked = rank_in_group(
        df.join(F.broadcast(sized.select("label", F.col("position").alias("_c"))), "label"),
        ["label"],
        hash_bucket(u),
        [u, F.col(key)],
        out="round",
        bounded=True,
    ).withColumn("_sizes", sizes)
    before = F.aggregate(
        "_sizes",
        F.lit(0).cast("long"),
        lambda acc, s: acc
        + F.least(s["n"], F.col("round") - 1)
        + F.when((s["position"] < F.col("_c")) & (s["n"] >= F.col("round")), 1).otherwise(0),
    )
    return ranked.withColumn("position", before + 1).drop("_c", "_sizes").orderBy("position")


def exact_quota(df: DataFrame, quota: DataFrame, order: str, span: int = 65_536) -> DataFrame:
    """Hard stop at the class quota in arrival order, counted after failures."""
    ok = df.where(~F.col("failed"))
    return take_lowest(
        ok, ["label"], quota, F.floor(F.col(order) / span).cast("int"), [F.col(order)], bounded=True
    )


def cap_per_class(df: DataFrame, cap: int, seed: int = 42, key: str = "name") -> DataFrame:
    """At most ``cap`` rows per class, classes below the cap whole."""
    if cap <= 0:
        return df
    return bottom_k(df, ["label"], cap, key, seed, bounded=True)


def select_exact_per_class(
    df: DataFrame,
    n: int,
    classes: DataFrame,
    seed: int = 42,
    source_offset: int = 0,
    key: str = "patch_uid",
) -> DataFrame:
    """Exactly ``n`` rows per class in a reshuffled order; 0 takes all.

    A class with fewer than ``n`` rows (or none) fails the job.
    """
    have = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    short = (
        classes.select("label")
        .join(have, "label", "left")
        .where(F.coalesce("_n", F.lit(0)) < max(n, 1))
        .agg(F.array_join(F.array_sort(F.collect_list("label")), ","))
        .scalar()
    )
    wanted = df.join(F.broadcast(classes.select("label")), "label", "left_semi")
    chosen = wanted if n <= 0 else bottom_k(wanted, ["label"], n, key, seed + source_offset, bounded=True)
    fail = F.raise_error(F.concat(F.lit("too few rows for class "), F.col("_short"))).cast("boolean")
    return (
        chosen.withColumn("_short", short)
        .where(F.when(F.col("_short") == "", F.lit(True)).otherwise(fail))
        .drop("_short")
        .withColumn("shuffle_u", u01(f"{seed + source_offset}-order", key))
        .orderBy("shuffle_u", key)
    )


def cap_rows(df: DataFrame, cap: int, seed: int = 42, by: str = "foundation", key: str = "name") -> DataFrame:
    """Uniform cap per source, original (patient, slide, name) order kept."""
    kept = df if cap <= 0 else bottom_k(df, [by], cap, key, seed, bounded=True)
    return kept.orderBy(by, "patient", "slide", key)


def per_specimen_cap(df: DataFrame, cap: int, seed: int = 42, key: str = "patch_uid") -> DataFrame:
    """At most ``cap`` rows per (specimen, class)."""
    return bottom_k(df, ["specimen", "label"], cap, key, seed)


def donor_candidates(
    df: DataFrame, min_cell: int, per_cell: int, num_donors: int, seed: int = 42
) -> DataFrame:
    """First ``per_cell`` patches of every large (patient, class) cell, then a uniform cap."""
    big = (
        df.groupBy("patient", "label")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_cell)
        .drop("_n")
    )
    first = first_by(
        df.join(big, ["patient", "label"], "left_semi"),
        ["patient", "label"],
        [F.col("slide"), F.col("name")],
        per_cell,
    )
    return bottom_k(first, [], num_donors, "name", seed)


def sample_per_slide(
    df: DataFrame, per_slide: int, max_slides: int = 0, seed: int = 42, key: str = "name"
) -> DataFrame:
    """At most ``per_slide`` patches per slide, optionally from ``max_slides`` slides."""
    if max_slides > 0:
        slides = bottom_k(df.select("slide").distinct(), [], max_slides, "slide", f"{seed}-slide")
        df = df.join(slides, "slide", "left_semi")
    return bottom_k(df, ["slide"], per_slide, key, seed)


def tile_cap_per_section(tiles: DataFrame, cap: int, seed: int = 42, key: str = "tile") -> DataFrame:
    """Random cap of kept tiles per section image; 0 keeps all."""
    return tiles if cap <= 0 else bottom_k(tiles, ["image_id"], cap, key, seed)


def stratified_split(df: DataFrame, frac: float, seed: int = 42, key: str = "name") -> DataFrame:
    """Mark a stratified calibration share: ``role`` is ``cal`` or ``fit``.

    Without at least two classes of two rows each, or with a share outside (0, 0.5),
    everything is ``fit``.  Rows away from the cut never shuffle.
    """
    if not 0.0 < frac < 0.5:
        return df.withColumn("role", F.lit("fit"))
    u = u01(seed, key)
    tagged = df.withColumn("_piece", hash_bucket(u))
    pieces = piece_counts(tagged, ["label"], F.col("_piece"))
    size = pieces.groupBy("label").agg(F.sum("_n").alias("_size"))
    over = W.partitionBy()  # one row per class
    usable = (F.min("_size").over(over) >= 2) & (F.count(F.lit(1)).over(over) >= 2)
    want = size.select(
        "label", F.when(usable, F.floor(F.col("_size") * frac + 0.5)).otherwise(0).alias("_k")
    )
    cut = (
        pieces.join(F.broadcast(want), "label")
        .where(F.col("_before") < F.col("_k"))
        .groupBy("label")
        .agg(
            F.max("_piece").alias("_cut"),
            F.max("_before").alias("_before"),
            F.max("_k").alias("_k"),
        )
    )
    marked = tagged.join(F.broadcast(cut), "label", "left")
    away = marked.where(F.col("_cut").isNull() | (F.col("_piece") != F.col("_cut"))).withColumn(
        "role", F.when(F.col("_piece") < F.col("_cut"), "cal").otherwise("fit")
    )
    rn = F.row_number().over(W.partitionBy("label").orderBy(u, F.col(key)))
    edge = marked.where(F.col("_piece") == F.col("_cut")).withColumn(
        "role", F.when(rn <= F.col("_k") - F.col("_before"), "cal").otherwise("fit")
    )
    return away.unionByName(edge).drop("_piece", "_cut", "_before", "_k")


def index_export_sorted(df: DataFrame) -> DataFrame:
    """The flat index in (class, specimen, image, position) order."""
    return df.orderBy("label_int", "specimen", "image_id", "left", "top")


def probe_gate(
    tiles: DataFrame, probe_tiles: int, priority: tuple[str, ...], seed: int = 42, key: str = "tile"
) -> DataFrame:
    """All tiles of the images whose first probe tiles (hash order) show a priority class."""
    probed = first_by(tiles, ["image_id"], [u01(seed, key), F.col(key)], probe_tiles)
    hit = probed.where(F.col("label").isin(*priority)).select("image_id").distinct()
    return tiles.join(hit, "image_id", "left_semi")


def probe_report(
    tiles: DataFrame, probe_tiles: int, priority: tuple[str, ...], seed: int = 42, key: str = "tile"
) -> DataFrame:
    """Probe hits per image and priority class."""
    probed = first_by(tiles, ["image_id"], [u01(seed, key), F.col(key)], probe_tiles)
    return probed.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_probed"),
        *[F.count_if(F.col("label") == c).alias(f"hits_{c}") for c in priority],
    )


def tile_grid(
    sections: DataFrame, downsample: int = 0, variant: str = "whole", tile: int = 512
) -> DataFrame:
    """Tile origins of each section at step ``tile * 2^downsample``.

    ``whole`` emits only tiles that fit; ``any`` also emits (0, 0) along an axis that
    is shorter than one tile.
    """
    step = tile * 2**downsample

    def origins(size: Column) -> Column:
        fits = F.sequence(F.lit(0), F.greatest(size - step, F.lit(0)), F.lit(step))
        none = F.array().cast("array<int>")
        short = F.array(F.lit(0)) if variant == "any" else none
        return F.when(size >= step, fits).otherwise(short)

    if variant not in ("whole", "any"):
        raise ValueError(f"unknown variant {variant!r}")
    return (
        sections.withColumn("top", F.explode(origins(F.col("height"))))
        .withColumn("left", F.explode(origins(F.col("width"))))
        .withColumn("tile", F.concat_ws(":", F.col("image_id").cast("string"), "left", "top"))
    )


def raster_level(sections: DataFrame, downsample: int, max_dim: int) -> DataFrame:
    """Smallest level >= ``downsample`` whose longer side fits ``max_dim``."""
    longest = F.greatest("width", "height").cast("long")
    levels = F.sequence(F.lit(downsample), F.lit(downsample + 40))
    fits = F.filter(
        levels, lambda d: F.floor(longest / F.pow(F.lit(2.0), d)) <= max_dim
    )
    return sections.withColumn("level", F.get(fits, F.lit(0)))


def crop_grid(images: DataFrame, crop_size: int, n_crops: int) -> DataFrame:
    """Crop boxes of an image for 1, 3, 5 or 9 positions."""
    # Fixed values: (column, row) of each crop on the 3 x 3 grid, centre first.
    layouts = {
        1: [(1, 1)],
        3: [(1, 1), (0, 0), (2, 2)],
        5: [(1, 1), (0, 0), (2, 0), (0, 2), (2, 2)],
        9: [(x, y) for y in range(3) for x in range(3)],
    }
    if n_crops not in layouts:
        raise ValueError(f"unsupported number of crops {n_crops}")
    size = F.least(F.lit(max(1, crop_size)), F.col("width"), F.col("height"))

    def at(side: Column, place: int) -> Column:
        room = F.greatest(side - size, F.lit(0))
        return [F.lit(0), F.floor(room / 2), room][place].cast("int")

    boxes = [
        F.struct(
            F.lit(i).alias("crop"),
            at(F.col("width"), px).alias("x0"),
            at(F.col("height"), py).alias("y0"),
        )
        for i, (px, py) in enumerate(layouts[n_crops])
    ]
    room = F.greatest(F.col("width") - size, F.col("height") - size)
    return (
        images.withColumn("b", F.explode(F.array(*boxes)))
        .withColumn("collapsed", (room == 0) & F.lit(n_crops > 1))
        .select(
            *images.columns,
            "b.crop",
            "b.x0",
            "b.y0",
            (F.col("b.x0") + size).alias("x1"),
            (F.col("b.y0") + size).alias("y1"),
            "collapsed",
        )
    )

