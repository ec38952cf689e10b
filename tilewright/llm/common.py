"""Reading tables and writing intermediate results where every executor sees them."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.session import shared_dir


#: Tables that a Python worker keeps between tasks; a reused worker may hold those of earlier stages.
TABLES: list[dict] = []


def release(keep: tuple[dict, ...] = ()) -> None:
    """Drop the tables of earlier stages, all but ``keep``, and give free memory back to the system."""
    for t in TABLES:
        if not any(t is k for k in keep):
            t.clear()
    trim()


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    given = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if given:
        given(0)


def tidy(run: Callable, keep: Callable[[], tuple[dict, ...]] = tuple) -> Callable:
    """``run`` over batches; memory that it leaves free goes back to the system, as a reused worker outlives the stage.

    The tables that ``keep`` names in the worker stay for the stage's next task, until one of another stage drops them.
    """

    def tidied(batches: Iterator) -> Iterator:
        release(keep())
        yield from run(batches)
        release(keep())

    return tidied


def tidy_group(run: Callable) -> Callable:
    """As ``tidy``, for a function of one group; tables stay for the next one."""

    def tidied(group):
        out = run(group)
        trim()
        return out

    return tidied


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage and survives lost executors; the folder keeps its scheme, so it may lie in
    any file system that Spark can write.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or shared_dir(spark)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
