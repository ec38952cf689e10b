"""Identifier grammars: patient and slide ids, patch file names, patch uids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.schema import CLASSES, UID_PREFIX, int_to_label, label_to_int

# Texts that stand for "no patient / no slide".
UNMAPPED_TEXTS = ("", "-1", "nan", "None", "unmapped")

# File-name and uid grammars. The file name is anchored on the
# right, so a specimen may itself contain underscores.
PATCH_FILENAME = (
    r"(?i)^(.+)_(\d+)_(\d+)_(\d+)_d(\d+)_([A-Za-z0-9]+)\.(png|jpg|jpeg)$"
)
PATCH_UID = "^" + UID_PREFIX + r"::(.+)::(\d+)::(\d+)::(\d+)::d(\d+)$"

_SEP = "\u0001"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _safe_id(value, prefix: str, width: int) -> Column:
    text = _col(value).cast("string")
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return (
        F.when(text.isNull() | text.isin(*UNMAPPED_TEXTS), F.lit(f"{prefix}-unmapped"))
        .when(number.isNotNull(), F.format_string(f"{prefix}-%0{width}d", number))
        .otherwise(
            F.concat(F.lit(f"{prefix}-"), F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"))
        )
    )


def safe_patient(value) -> Column:
    return _safe_id(value, "patient", 3)


def safe_slide(value) -> Column:
    return _safe_id(value, "slide", 4)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Array holding the match's groups as one array, or empty without a match.

    The pattern runs once: the text is rewritten to its groups and split.  A lambda
    tests the pieces, because a filter on the result would make the optimizer copy
    the whole match into every use.
    """
    joined = F.regexp_replace(text, pattern, _SEP.join(f"${i}" for i in range(1, n + 1)))
    return F.filter(F.array(F.split(joined, _SEP, -1)), lambda p: F.size(p) == n)


def fields(text, pattern: str, n: int) -> Column:
    """All groups of a match as an array; NULL when the text does not match."""
    return F.get(_groups(_col(text), pattern, n), F.lit(0))


def make_patch_uid(specimen, image_id, left, top, downsample) -> Column:
    """Path- and label-independent id of one physical tile."""
    return F.concat_ws(
        "::",
        F.lit(UID_PREFIX),
        _col(specimen),
        _col(image_id).cast("string"),
        _col(left).cast("string"),
        _col(top).cast("string"),
        F.concat(F.lit("d"), _col(downsample).cast("string")),
    )


def parse_patch_filename(df: DataFrame, filename: str = "filename", keep: bool = False) -> DataFrame:
    """Add the fields of a patch file name; rows that do not parse are dropped, or kept without fields (``keep``)."""
    known = [F.lit(c) for c in CLASSES]
    parsed = F.filter(
        _groups(F.col(filename), PATCH_FILENAME, 7),
        lambda p: F.array_contains(F.array(*known), F.upper(p[5])),
    )
    uid = make_patch_uid("specimen", "image_id", "left", "top", "downsample")
    return (
        df.withColumn("_f", F.explode_outer(parsed) if keep else F.explode(parsed))
        .withColumn("label", F.upper(F.col("_f")[5]))
        .withColumn("label_int", label_to_int(F.col("label")).cast("short"))
        .withColumn("specimen", F.col("_f")[0])
        .withColumn("image_id", F.col("_f")[1].cast("long"))
        .withColumn("left", F.col("_f")[2].cast("long"))
        .withColumn("top", F.col("_f")[3].cast("long"))
        .withColumn("downsample", F.col("_f")[4].cast("short"))
        .withColumn("patch_uid", F.when(F.col("specimen").isNotNull(), uid) if keep else uid)
        .drop("_f")
    )


def parse_patch_uid(df: DataFrame, uid: str = "patch_uid", strict: bool = True) -> DataFrame:
    """Add the fields of a patch uid; a malformed uid fails the job unless lenient."""
    parts = fields(uid, PATCH_UID, 5)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unexpected patch uid: "), F.col(uid)))
        parts = F.coalesce(parts, bad.cast("array<string>"))
    return (
        df.withColumn("_f", F.explode(F.array(parts)))
        .withColumn("specimen", F.col("_f")[0])
        .withColumn("image_id", F.col("_f")[1].cast("long"))
        .withColumn("left", F.col("_f")[2].cast("long"))
        .withColumn("top", F.col("_f")[3].cast("long"))
        .withColumn("downsample", F.col("_f")[4].cast("short"))
        .drop("_f")
    )


def canonical_filename(specimen, image_id, left, top, downsample, label_int) -> Column:
    return F.format_string(
        "%s_%d_%d_%d_d%d_%s.png",
        _col(specimen),
        _col(image_id).cast("long"),
        _col(left).cast("long"),
        _col(top).cast("long"),
        _col(downsample).cast("long"),
        int_to_label(_col(label_int)),
    )


def slide_of_path(path) -> Column:
    """Slide id of an image path: the file stem up to ``_patch_``."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.rlike(r"^.*_patch_"), F.regexp_extract(stem, r"^(.*)_patch_.*$", 1)).otherwise(
        stem
    )


def augmented_tag(foundation: str, suffix: str) -> str:
    """Name tag of one augmentation pool, without the foundation, so that views of
    the same patch carry the same name in every foundation."""
    lead = f"{foundation}_"
    return suffix[len(lead):] if suffix.startswith(lead) else suffix


def label_source_tag(name, tag) -> Column:
    return F.concat(_col(tag), F.lit("::"), _col(name))
