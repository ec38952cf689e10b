"""A registry of keys in hash partitions, with a membership filter for each block.

A block of keys is written as ``block=B/part=P`` folders, and its filters, one bitmap of about ten bits
a key for each part, as one small file beside them. A batch asks the filters of the parts that its keys fall in;
only (block, part) folders in which a filter sees one of its keys are opened, and their keys decide. A batch
of new keys opens next to nothing, however many blocks there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a block; a bitmap has so many bits for each key, and no fewer than the least.
PARTS, BITS_PER_KEY, LEAST_BITS, PROBES = 16, 10, 1024, 4


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its file system; faults other than its absence are raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _places(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bits of each hash: rows of ``PROBES`` places below ``n``."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(n)).astype(np.int64)


def _bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(-(-len(hashes) * BITS_PER_KEY // 8) * 8, LEAST_BITS), np.uint8)
    bits[_places(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def _seen(hashes: np.ndarray, bitmap: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))
    return bits[_places(hashes, len(bits))].all(axis=1)


def _filters(registry: str) -> str:
    return f"{registry}-filters"


def register(keys: DataFrame, registry: str, block: str, key: str) -> None:
    """Write the keys of a block and its filters; a block of that name is replaced.

    The filters come first: a filter without keys opens nothing, keys without a filter would be missed.
    """
    spark = keys.sparkSession
    rows = keys.select(key, part_of(key).alias("part"), F.xxhash64(key).alias("h"))
    build = lambda k, g: pd.DataFrame({"part": [k[0]], "bits": [_bitmap(g["h"].to_numpy())]})
    filters = rows.select("part", "h").groupBy("part").applyInPandas(build, "part int, bits binary")
    filters.coalesce(1).write.mode("overwrite").parquet(f"{_filters(registry)}/block={block}")
    path = f"{registry}/block={block}"
    rows.select(key, "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
    if not exists(spark, f"{path}/_SUCCESS"):  # an empty block has a folder, too
        rows.select(key).limit(0).write.mode("overwrite").parquet(path)


def hits(keys: DataFrame, registry: str, key: str, without: str | None = None) -> list[tuple[str, int]]:
    """The (block, part) folders in which one of the keys may be; ``without`` names a block to leave out."""
    spark = keys.sparkSession
    if not exists(spark, _filters(registry)):
        return []
    asked = keys.select(part_of(key).alias("part"), F.xxhash64(key).alias("h")).distinct()
    filters = spark.read.schema("part int, bits binary, block string").parquet(_filters(registry))
    if without is not None:
        filters = filters.where(F.col("block") != without)

    def probe(mine: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        h = mine["h"].to_numpy()
        found = [(b, int(p)) for b, p, bits in zip(blocks["block"], blocks["part"], blocks["bits"]) if len(h) and _seen(h, bits).any()]
        return pd.DataFrame(found, columns=["block", "part"])

    met = asked.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(probe, "block string, part int")
    return sorted((r["block"], r["part"]) for r in met.collect())  # at most blocks x parts names


def without_known(batch: DataFrame, registry: str, key: str, block: str | None = None) -> DataFrame:
    """The rows whose key no block registers, ``block`` itself left aside; null keys are never known."""
    spark = batch.sparkSession
    folders = [f"{registry}/block={b}/part={p}" for b, p in hits(batch, registry, key, block)]
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return batch
    known = spark.read.schema(batch.select(key).schema).parquet(*folders)
    return batch.join(known, key, "left_anti")
