"""Content hashes: configuration ids, input fingerprints, pixel digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.vectors import let

NUL = "\u0000"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _from_java(text: Column) -> Column:
    """Spark's text of a non-negative double in the shortest JSON form."""

    def scientific(parts: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(parts[0], r"\.", ""), r"0+$", "")
        return let(
            F.struct(
                F.when(digits == "", "0").otherwise(digits).alias("d"), parts[1].cast("int").alias("e")
            ),
            spelled,
        )

    def spelled(v: Column) -> Column:
        d, e = v["d"], v["e"]
        tail = F.substring(d, 2, 40)
        mantissa = F.concat(F.substring(d, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)))
        padded = F.rpad(d, F.greatest(e + 2, F.length(d)), "0")
        return (
            F.when(e == -4, F.concat(F.lit("0.000"), d))
            .when((e >= 0) & (e < 16), F.concat(F.substr(padded, F.lit(1), e + 1), F.lit("."), F.substr(padded, e + 2)))
            .otherwise(
                F.concat(
                    mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(e))
                )
            )
        )

    return F.when(text.contains("E"), let(F.split(text, "E"), scientific)).otherwise(text)


def json_number(x) -> Column:
    """A double in the shortest JSON text form with a two-digit exponent (3e-05, 0.1, 2.0).

    NaN and infinities, which JSON lacks, are spelled as strings.
    """

    def spell(v: Column) -> Column:
        return (
            F.when(F.isnan(v), F.lit('"__NaN__"'))
            .when(v == float("inf"), F.lit('"__Infinity__"'))
            .when(v == float("-inf"), F.lit('"__-Infinity__"'))
            .when(v.isNull(), F.lit("null"))
            .otherwise(F.concat(F.when(v < 0, "-").otherwise(""), let(F.abs(v).cast("string"), _from_java)))
        )

    return let(_col(x).cast("double"), spell)


def json_string(s) -> Column:
    """A JSON string literal."""
    body = F.to_json(F.struct(_col(s).alias("s")))
    return F.when(_col(s).isNull(), F.lit("null")).otherwise(F.substr(body, F.lit(6), F.length(body) - 6))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no blanks from ready-made JSON values."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(f'{"," if i else "{"}"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def config_id(fields: dict[str, Column]) -> Column:
    """First 12 hex digits of the sha1 of the canonical JSON."""
    return F.substring(F.sha1(canonical_json(fields)), 1, 12)


def input_fingerprint(
    files: DataFrame,
    by: list[str],
    name: str = "name",
    size: str = "size_bytes",
    mtime: str = "mtime_s",
    buckets: int = 4096,
) -> DataFrame:
    """One digest per source over (name, size, mtime) of all its files.

    Two levels, so that no task holds a whole listing: a digest per name bucket over
    its sorted entries, then a digest over the bucket digests (at most ``buckets``).
    """
    entry = F.concat_ws(NUL, name, F.col(size).cast("string"), F.col(mtime).cast("string"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(name)), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    leaves = (
        files.select(*by, entry.alias("e"), bucket.alias("b"))
        .groupBy(*by, "b")
        .agg(
            F.sha1(F.concat_ws(NUL, F.array_sort(F.collect_list("e")))).alias("d"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return leaves.groupBy(*by).agg(
        F.sum("n").alias("n_files"),
        F.sha1(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]
                ),
                NUL,
            )
        ).alias("fingerprint"),
    )


def pixel_sha256(width, height, rgb) -> Column:
    """Digest of the decoded pixels: a size header, then the raw RGB bytes."""
    header = F.format_string("RGB:%dx%d\n", _col(width), _col(height))
    return F.sha2(F.concat(header.cast("binary"), _col(rgb)), 256)


def parse_nested_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Optional nested structure record and a number that may be text or junk."""
    rec = F.from_json(raw, "structure struct<acronym:string,name:string>, area string")
    return df.withColumn("_r", rec).select(
        *[c for c in df.columns if c != raw],
        F.col("_r.structure.acronym").alias("acronym"),
        F.col("_r.structure.name").alias("structure_name"),
        F.col("_r.area").try_cast("double").alias("area"),
    )
