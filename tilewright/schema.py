"""Logical schemas and the fixed label domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class names in label order 0..9, and the five classes that the
# external patch collections cover.
CLASSES = ("CT", "DM", "IC", "LI", "MP", "NC", "PL", "PN", "WM", "NOTA")
EXTERNAL_CLASSES = ("CT", "IC", "MP", "NC", "PN")
N_CLASSES = len(CLASSES)
EXTERNAL_CLASS_IDS = tuple(CLASSES.index(c) for c in EXTERNAL_CLASSES)

# Fixed value: first segment of every external patch uid.
UID_PREFIX = "ivy-gap"

TILE = 512
UNLABELLED = -1

PATCH = T.StructType(
    [
        T.StructField("foundation", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("patient", T.StringType()),
        T.StructField("slide", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("label", T.ShortType()),
        T.StructField("x", T.ArrayType(T.FloatType(), False)),
    ]
)

MAPPING = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("Patient", T.IntegerType()),
        T.StructField("Slide", T.IntegerType()),
    ]
)

PATCH_RECORD = T.StructType(
    [
        T.StructField("patch_uid", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source_relpath", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("specimen", T.StringType()),
        T.StructField("image_id", T.LongType()),
        T.StructField("left", T.LongType()),
        T.StructField("top", T.LongType()),
        T.StructField("downsample", T.ShortType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_int", T.ShortType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

HEAD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("cls", T.IntegerType()),
        T.StructField("coef", T.ArrayType(T.DoubleType(), False)),
        T.StructField("intercept", T.DoubleType()),
    ]
)


def label_to_int(label: Column) -> Column:
    """Class name (any case) -> 0..9, NULL for a name outside the domain."""
    pos = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.upper(label))
    return F.when(pos > 0, pos - 1).cast("int")


def int_to_label(label_int: Column) -> Column:
    """0..9 -> class name, NULL outside the domain."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.when(label_int.between(0, N_CLASSES - 1), F.get(names, label_int.cast("int")))


def class_table(spark: SparkSession, classes=CLASSES) -> DataFrame:
    """One row per class of ``classes``: (label, label_int, position)."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("label"),
                    F.lit(CLASSES.index(c)).alias("label_int"),
                    F.lit(i).alias("position"),
                )
                for i, c in enumerate(classes)
            ]
        )
    )
    return spark.range(1).select(rows.alias("c")).select("c.*")
