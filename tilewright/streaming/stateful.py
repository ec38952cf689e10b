"""Stateful operators of the live feed: rows held by a timer, quotas filled across batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tilewright.functions.hashing import u01
from tilewright.shipping import by_value

#: Keys that held rows are spread over; a key's state is what it holds at a time.
HOLDERS = 256

#: State in RocksDB; a run ends when its data is through, it does not go on with empty batches for its timers.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession):
    """The settings of the queries that are started inside."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Hold(StatefulProcessor):
    """Passes rows that are old enough on the clock; a timer releases the others when they are.

    ``mtime`` is in microseconds here.
    """

    def __init__(self, schema: StructType, seconds: float):
        self.schema, self.wait = schema, int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # numbered fields: the state's rows are made by keyword, and a column may be called ``cls``
        self.held = handle.getListState("held", StructType([StructField(f"f{i}", f.dataType) for i, f in enumerate(self.schema)]))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.schema.fieldNames())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        due: set[int] = set()
        for pdf in rows:
            pdf = pdf[self.schema.fieldNames()]
            when = pdf["mtime"].fillna(0).to_numpy(np.int64) + self.wait  # no time: old
            young = when > now
            if young.any():
                self.held.appendList([tuple(None if pd.isna(v) else v for v in r) for r in pdf[young].astype(object).itertuples(index=False, name=None)])
                due.update((-(-when[young] // 1_000_000) * 1000).tolist())  # one timer a second
            yield pdf[~young]
        for at in due:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        rows = list(self.held.get())
        at = self.schema.fieldNames().index("mtime")
        young = [r for r in rows if r[at] + self.wait > now]
        if young:
            self.held.put(young)
        else:
            self.held.clear()
        yield self._frame([tuple(r) for r in rows if r[at] + self.wait <= now])


class Fill(StatefulProcessor):
    """Takes rows of a class in the order of ``u01``, then ``path``, until its quota is full; the state is what it took."""

    def __init__(self, columns: list[str], quota: dict[str, int]):
        self.columns, self.quota = columns, quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        left, best = self.quota.get(key[0], 0) - taken, None
        if left <= 0:
            return
        for pdf in rows:  # no more than the quota is kept at a time
            if not len(pdf):
                continue
            best = (pdf if best is None else pd.concat([best, pdf])).sort_values(["u01", "path"], kind="stable").head(left)
        if best is not None and len(best):
            self.taken.update((taken + len(best),))
            yield best[self.columns]


def _plain_types(feed: DataFrame) -> StructType:
    """The feed's columns with ``mtime`` in microseconds, which no time zone changes on the way through pandas."""
    return StructType([StructField(f.name, LongType() if f.name == "mtime" else f.dataType) for f in feed.schema])


def held_by_age(feed: DataFrame, seconds: float, key: str = "patch_uid") -> DataFrame:
    """The feed's rows, each as soon as its ``mtime`` is ``seconds`` old on the clock."""
    types = _plain_types(feed)
    spread = feed.withColumn("mtime", F.unix_micros("mtime")).withColumn("_holder", F.pmod(F.xxhash64(key), F.lit(HOLDERS)))
    with by_value(__name__):
        out = spread.groupBy("_holder").transformWithStateInPandas(Hold(types, seconds), types, "Append", "ProcessingTime")
    return out.withColumn("mtime", F.timestamp_micros("mtime"))


def with_tick(feed: DataFrame, ticks: str) -> DataFrame:
    """The feed and one row of size -1 from the folder ``ticks``, so that a run has a batch, and its timers fire, on a quiet feed."""
    spark = feed.sparkSession
    row = [F.lit(-1 if f.name == "size" else None).cast(f.dataType).alias(f.name) for f in feed.schema]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(ticks)
    return feed.unionByName(spark.readStream.schema(feed.schema).option("cleanSource", "delete").parquet(ticks))


def filled(feed: DataFrame, quota: dict[str, int], seed: int = 42) -> DataFrame:
    """The rows that fill the class quotas; inside a batch they come in hash order.

    A piece of a batch sends at most a quota of rows of each class to the class's task, which holds that many: for
    small quotas. ``ingest.stream_quota`` takes any.
    """
    types = _plain_types(feed)
    rows = feed.where(F.col("cls").isin(*quota) if quota else F.lit(False)).withColumn("mtime", F.unix_micros("mtime")).withColumn("u01", u01(seed, "path"))

    def prune(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces:
            order = pdf.sort_values(["u01", "path"], kind="stable")
            rank = order.groupby("cls").cumcount()
            yield order[rank < order["cls"].map(quota)]

    pruned = rows.mapInPandas(prune, rows.schema)
    # the state's keys are rows made by keyword, so theirs is not called ``cls``; names in pandas start with a letter
    with by_value(__name__):
        out = pruned.withColumn("of_class", F.col("cls")).groupBy("of_class").transformWithStateInPandas(Fill(feed.columns, quota), types, "Append", "None")
    return out.withColumn("mtime", F.timestamp_micros("mtime"))


def run_blocks(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stateful stream over all that is there; ``write`` gets each batch."""
    with settings(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
