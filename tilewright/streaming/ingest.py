"""Structured Streaming over a live patch directory.

The feed is a folder that another process keeps writing. Each micro-batch takes the
new files; rows are held until they are old enough, deduplicated, counted against class
quotas, and committed data first, registry second. What is held lies in keyed state (``stateful``);
committed keys lie in a partitioned registry (``keys``).

Every write goes to a block named after the checkpoint's own id and the batch, so a replayed
batch overwrites itself, while a new checkpoint, whose batches start at 0 again, adds blocks
beside the old ones and skips what they hold.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators.ranking import bottom_k, first_by
from tilewright.streaming.keys import exists, register, remove, without_known
from tilewright.streaming.stateful import held_by_age, run_blocks, with_tick

FEED = "event_id bigint, path string, patch_uid string, cls string, mtime timestamp, size bigint"


def read_feed(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = FEED) -> DataFrame:
    """The feed folder as a stream; files are taken in the order they appeared."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(writer, checkpoint: str) -> StreamingQuery:
    """Run a stream until everything available is processed."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the checkpoint; a lost checkpoint gets another one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _block(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    return f"{run_id(spark, checkpoint)}-{batch_id}"


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All blocks below ``path`` with their name; empty before the first one."""
    empty = spark.createDataFrame([], f"{schema}, block string")
    return spark.read.schema(empty.schema).parquet(path).select(*empty.columns) if exists(spark, path) else empty


def committer(data: str, registry: str, checkpoint: str, schema: str = FEED, key: str = "patch_uid") -> Callable:
    """A ``foreachBatch`` function: non-empty files, once per key, data then registry."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        commit_block(batch, _block(batch.sparkSession, checkpoint, batch_id), data, registry, schema, key)

    return commit


def commit_block(batch: DataFrame, block: str, data: str, registry: str, schema: str = FEED, key: str = "patch_uid") -> None:
    """Commit a batch as ``block``: what any other block registers is left out."""
    spark = batch.sparkSession
    new = first_by(batch.where("size > 0"), [key], [F.col("mtime"), F.col("path")])
    out = f"{data}/block={block}"
    without_known(new, registry, key, block).write.mode("overwrite").parquet(out)
    register(spark.read.schema(schema).parquet(out).select(key), registry, block, key)


def recover(spark: SparkSession, data: str, registry: str, key: str = "patch_uid") -> list[str]:
    """Register data blocks that a crash left without a registry entry.

    A block whose registry holds only a part of its keys is an error.
    """
    blocks = written(spark, data, f"{key} string")
    have = written(spark, registry, f"{key} string")
    state = (
        blocks.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(have.groupBy("block").agg(F.count(F.lit(1)).alias("r")), "block", "left")
        .where(F.coalesce("r", F.lit(0)) != F.col("n"))
        .collect()  # one row per broken block
    )
    partial = [r["block"] for r in state if r["r"]]
    if partial:
        raise RuntimeError(f"partially registered blocks {partial}")
    for r in state:
        b = r["block"]
        register(blocks.where(F.col("block") == b).select(key), registry, b, key)
    return sorted(r["block"] for r in state)


def stream_ingest(feed: DataFrame, root: str, schema: str = FEED) -> DataFrame:
    """Drain the feed through the committer; returns the committed rows."""
    commit = committer(f"{root}/data", f"{root}/registry", f"{root}/ckpt", schema)
    drain(feed.writeStream.foreachBatch(commit), f"{root}/ckpt")
    return written(feed.sparkSession, f"{root}/data", schema)


def stream_min_age(feed: DataFrame, root: str, seconds: float = 120, schema: str = FEED) -> DataFrame:
    """Drain the feed; returns the files that are old enough by now, once per uid, with path and class.

    Old files are committed as they come, late ones, too. Young rows, and no others, go by the folder ``young``, which
    is removed at the end, to a second stream that holds them in its state until a timer of the clock releases them;
    the next run passes what is due, with new files or without. What is held survives a lost checkpoint of the feed; a batch that is replayed
    may send a row twice, and the commit passes it once.
    """
    wait = int(seconds * 1e6)

    def split(batch: DataFrame, batch_id: int) -> None:
        block = _block(batch.sparkSession, f"{root}/ckpt", batch_id)
        young = F.coalesce(F.unix_micros("mtime") + wait > time.time_ns() // 1000, F.lit(False))  # no time: old
        rows = batch.where("size > 0")
        rows.where(young).write.mode("append").parquet(f"{root}/young")
        commit_block(rows.where(~young), block, f"{root}/out", f"{root}/registry", schema)

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        block = _block(spark, f"{root}/held", batch_id)
        passed = f"{root}/passed-{block}"  # the state is read once; the commit reads the rows more often
        batch.write.mode("overwrite").parquet(passed)
        commit_block(spark.read.schema(schema).parquet(passed), block, f"{root}/out", f"{root}/registry", schema)
        remove(spark, passed)

    spark = feed.sparkSession
    drain(feed.writeStream.foreachBatch(split), f"{root}/ckpt")
    spark.createDataFrame([], feed.schema).write.mode("append").parquet(f"{root}/young")  # a run without young rows fires timers, too
    young = spark.readStream.schema(feed.schema).parquet(f"{root}/young")
    run_blocks(held_by_age(with_tick(young, f"{root}/ticks").where("size > 0"), seconds), f"{root}/held", commit)
    remove(spark, f"{root}/young")  # the state has all of it
    return written(spark, f"{root}/out", schema)


def stream_dedup(feed: DataFrame, root: str, registry: DataFrame | None = None, schema: str = FEED) -> DataFrame:
    """First sight of every uid, however late; registered uids never pass."""

    def once(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        block = _block(spark, f"{root}/ckpt", batch_id)
        new = first_by(batch, ["patch_uid"], [F.col("mtime"), F.col("path")])
        if registry is not None:
            new = new.join(registry.select("patch_uid"), "patch_uid", "left_anti")
        out = f"{root}/out/block={block}"
        without_known(new, f"{root}/registry", "patch_uid", block).write.mode("overwrite").parquet(out)
        register(spark.read.schema(schema).parquet(out).select("patch_uid"), f"{root}/registry", block, "patch_uid")

    drain(feed.writeStream.foreachBatch(once), f"{root}/ckpt")
    return written(feed.sparkSession, f"{root}/out", schema)


def stream_quota(feed: DataFrame, root: str, quota: dict[str, int], schema: str = FEED, seed: int = 42) -> DataFrame:
    """Fill class quotas across batches and runs, inside a batch in the order of ``u01``, then ``path``.

    What any run wrote counts, also one with a checkpoint that was lost. Spark ranks a batch's rows, so no task holds
    a class.
    """
    spark = feed.sparkSession

    def count(rows: DataFrame) -> Counter:
        return Counter({r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()})  # one row per class

    taken = count(written(spark, f"{root}/out", schema))

    def keep(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        out = f"{root}/out/block={_block(here, f'{root}/ckpt', batch_id)}"
        if exists(here, out):  # a replayed batch takes its places anew
            taken.subtract(count(here.read.schema(schema).parquet(out)))
        left = here.createDataFrame([(c, max(q - taken[c], 0)) for c, q in quota.items()], "cls string, k long")
        bottom_k(batch.where("size > 0"), ["cls"], left, "path", seed, bounded=True).select(*batch.columns).write.mode("overwrite").parquet(out)
        taken.update(count(here.read.schema(schema).parquet(out)))

    drain(feed.writeStream.foreachBatch(keep), f"{root}/ckpt")
    return written(spark, f"{root}/out", schema)


def stream_class_counts(feed: DataFrame, root: str) -> DataFrame:
    """Running counts per class; returns the last state of every class.

    Blocks carry the run and its start: after a lost checkpoint the new run counts all files anew, and
    its blocks come after those of the old one, whatever their batch ids are.
    """
    spark = feed.sparkSession
    counts = feed.where("size > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    stamp = time.time_ns()

    def keep(batch: DataFrame, batch_id: int) -> None:
        block = _block(batch.sparkSession, f"{root}/ckpt", batch_id)
        rows = batch.select("cls", "n", F.lit(stamp).alias("started"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        rows.write.mode("overwrite").parquet(f"{root}/out/block={block}")

    drain(counts.writeStream.outputMode("update").foreachBatch(keep), f"{root}/ckpt")
    seen = written(spark, f"{root}/out", "cls string, n bigint, started bigint, batch_id bigint")
    return first_by(seen, ["cls"], [F.desc("started"), F.desc("batch_id")]).select("cls", "n")
