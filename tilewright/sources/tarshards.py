"""``spark.read.format("tarshards")``: samples of WebDataset-style tar shards.

Members that share a name up to the first dot form one sample. A shard is streamed, never held
whole. Filters on shard, pos, key and ext are applied before an image is read: other shards are not
opened, other members not read. A shard with an index beside it (``write_indexes``) is split by the
byte ranges of its members, and a task seeks to the members it keeps.

``write_tar_shards`` writes such shards, ``stream_tar_shards`` reads new ones as a stream, and
``fetch_targets`` reads planned keys only.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
)

from tilewright.shipping import by_value
from tilewright.sources.conditions import Conditions, Where, option
from tilewright.sources.files import expand, make_dirs, move, open_file, open_output, size_of
from tilewright.sources.staging import StagedWriter

# Field preference for the image and for the label.
IMAGE_FIELDS = ("jpg", "jpeg", "png", "webp")
LABEL_FIELDS = ("cls", "txt")

SCHEMA = "shard string, pos bigint, key string, ext string, bytes binary, label int"
_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("pos", pa.int64()),
        ("key", pa.string()),
        ("ext", pa.string()),
        ("bytes", pa.binary()),
        ("label", pa.int32()),
    ]
)
#: Where the members of a sample lie in their shard; ``label_size`` is 0 without a label.
PLACES = "path string, pos bigint, key string, ext string, at bigint, size bigint, label_at bigint, label_size bigint"
_PLACES = pa.schema(
    [("path", pa.string()), ("pos", pa.int64()), ("key", pa.string()), ("ext", pa.string())]
    + [(c, pa.int64()) for c in ("at", "size", "label_at", "label_size")]
)
BATCH_ROWS = 256
#: Samples of one row group of an index: what a task reads at least to find its range.
INDEX_ROWS = 2048
BATCH_BYTES = 32 << 20
SPLIT_BYTES = 128 << 20
INDEX = ".index"


class ShardPartition(InputPartition):
    """A shard, or the samples whose image starts in [start, stop) of an indexed one."""

    def __init__(self, path: str, start: int | None = None, stop: int | None = None):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class TarShards(DataSource):
    """Options: ``path`` (glob; a folder when writing), ``headerOnly`` (true skips the image bytes),
    ``where`` (conditions on shard, pos, key, ext), ``places`` (true returns where the members lie), ``splitBytes`` (range of a task in an indexed shard),
    ``log`` (folder that records the shards a stream has seen)."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def schema(self) -> str:
        return PLACES if self._flag("places") else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        return TarReader(self.options["path"], self._flag("headerOnly"), self._flag("places"), split, self.options.get("where", "[]"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TarStream(self.options["path"], self.options["log"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("shards are only appended; a shard of the same name is replaced")
        return TarWriter(self.options["path"])


def _first(fields: dict, names: tuple[str, ...]) -> str | None:
    return next((f for f in names if f in fields), None)


def _samples(tar: tarfile.TarFile) -> Iterator[tuple[str, dict[str, tarfile.TarInfo]]]:
    """(key, {field: member}) for runs of members with one key."""
    key, fields = None, {}
    for m in tar:
        if not m.isfile():
            continue
        folder, base = posixpath.split(m.name)
        stem, _, ext = base.partition(".")
        k = posixpath.join(folder, stem)
        k = k[2:] if k.startswith("./") else k
        if k != key:
            if fields:
                yield key, fields
            key, fields = k, {}
        fields[ext.lower()] = m
        tar.members = []  # keep no index of a long shard
    if fields:
        yield key, fields


def places(path: str) -> Iterator[tuple]:
    """The rows of ``PLACES`` for one shard, from its headers."""
    shard = posixpath.basename(path)
    with open_file(path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
        for pos, (key, fields) in enumerate(_samples(tar)):
            image, label = _first(fields, IMAGE_FIELDS), _first(fields, LABEL_FIELDS)
            if image is None:
                raise ValueError(f"{shard}/{key}: no image field")
            at, tag = fields[image], fields.get(label)
            yield path, pos, key, image, at.offset_data, at.size, tag.offset_data if tag else 0, tag.size if tag else 0


def _open_index(path: str, f) -> pq.ParquetFile:
    index = pq.ParquetFile(f)
    if int(index.schema_arrow.metadata[b"shard_bytes"]) != size_of(path):
        raise ValueError(f"{path}: the shard has changed since its index was written")
    return index


def _stretches(index: pq.ParquetFile) -> list[dict[str, tuple[int, int]]]:
    """Least and greatest ``pos`` and ``at`` of each row group, from the footer of the index."""
    meta, out = index.metadata, []
    for i in range(meta.num_row_groups):
        cols = (meta.row_group(i).column(j) for j in range(meta.num_columns))
        out.append({c.path_in_schema: (c.statistics.min, c.statistics.max) for c in cols if c.path_in_schema in ("pos", "at")})
    return out


def _indexed(path: str, start: int, stop: int) -> Iterator[tuple]:
    """As ``places``, for one range of an indexed shard; of the index, only the stretches that meet the range are read."""
    with open_file(path + INDEX) as f:
        index = _open_index(path, f)
        groups = [i for i, g in enumerate(_stretches(index)) if g["at"][0] < stop and g["at"][1] >= start]
        for batch in index.iter_batches(row_groups=groups):
            cols = batch.to_pydict()
            for row in zip(*cols.values()):
                if start <= row[3] < stop:
                    yield path, *row


def _load(raw, row: tuple, header_only: bool) -> tuple[bytes | None, int]:
    """Image bytes and label of a sample."""
    if header_only:
        return None, -1
    _, _, _, _, at, size, label_at, label_size = row
    raw.seek(at)
    data = raw.read(size)
    if not label_size:
        return data, -1
    raw.seek(label_at)
    return data, int(raw.read(label_size).decode().strip())


class TarReader(DataSourceReader):
    def __init__(
        self, pattern: str, header_only: bool = False, places_only: bool = False, split: int = SPLIT_BYTES, where: str = "[]"
    ):
        self.pattern, self.header_only, self.places_only, self.split = pattern, header_only, places_only, split
        self.where = Conditions(where, ("shard", "pos", "key", "ext"))

    def _wanted(self, path: str) -> bool:
        return self.where.passes("shard", posixpath.basename(path))

    def partitions(self) -> list[ShardPartition]:
        paths = expand(self.pattern)
        if not paths:
            raise FileNotFoundError(f"no shards match {self.pattern}")
        indexed = set(expand(self.pattern + INDEX))
        out = []
        for p in filter(self._wanted, paths):
            if p + INDEX in indexed:
                out += [ShardPartition(p, a, a + self.split) for a in self._splits(p)]
            else:
                out.append(ShardPartition(p))
        return out or [ShardPartition("")]

    def _splits(self, path: str) -> list[int]:
        """Starts of the ranges that hold a position below the last wanted one, from the footer of the index."""
        with open_file(path + INDEX) as f:
            last = self.where.last("pos")
            ends = [g["at"][1] for g in _stretches(_open_index(path, f)) if g["pos"][0] <= last]
        return list(range(0, max(ends, default=-1) + 1, self.split))

    def _rows(self, partition: ShardPartition) -> Iterator[tuple]:
        if partition.start is None:
            rows = places(partition.path)
        else:
            rows = _indexed(partition.path, partition.start, partition.stop)
        last = self.where.last("pos")
        for row in rows:
            if row[1] > last:
                return
            if all(self.where.passes(c, row[i]) for c, i in (("pos", 1), ("key", 2), ("ext", 3))):
                yield row

    def read(self, partition: ShardPartition):
        if not partition.path:
            return iter(())
        rows = self._rows(partition)
        if self.places_only:
            return _batches(rows, _PLACES, lambda r: 0)
        return self._loaded(partition.path, rows)

    def _loaded(self, path: str, rows: Iterator[tuple]):
        with open_file(path) as raw:
            shard = posixpath.basename(path)
            full = ((shard, r[1], r[2], r[3], *_load(raw, r, self.header_only)) for r in rows)
            yield from _batches(full, _ARROW, lambda r: len(r[4] or b""))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class TarStream(DataSourceStreamReader):
    """New shards once each. Offsets count the entries of a log that names the shards of each trigger.

    An entry is written before its offset is returned, so a restart replays the same shards; a shard is
    whole when it has its name (writers move it there). With a fresh checkpoint the log is read from its
    start: all shards come again, as for any source.
    """

    def __init__(self, pattern: str, log: str):
        self.pattern, self.log = pattern, log.rstrip("/")

    def _entries(self) -> list[str]:
        return expand(f"{self.log}/*.json")

    def _names(self, entry: str) -> list[str]:
        with open_file(entry) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        entries = self._entries()
        seen = {name for e in entries for name in self._names(e)}
        new = [p for p in expand(self.pattern) if posixpath.basename(p) not in seen]
        n = len(entries)
        if new:
            make_dirs(self.log)
            hidden = f"{self.log}/.{uuid.uuid4().hex}"
            with open_output(hidden) as out:
                out.write(json.dumps([posixpath.basename(p) for p in new]).encode())
            move(hidden, f"{self.log}/{n:010d}.json")
            n += 1
        return {"entry": n}

    def partitions(self, start: dict, end: dict) -> list[ShardPartition]:
        folder = posixpath.dirname(self.pattern)
        names = [n for e in self._entries()[start["entry"] : end["entry"]] for n in self._names(e)]
        return [ShardPartition(f"{folder}/{n}") for n in names]

    def read(self, partition: ShardPartition):
        return TarReader(self.pattern).read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the log is the record, Spark's checkpoint the position."""


class TarWriter(StagedWriter):
    """Rows (shard, key, ext, bytes, label) in runs of one shard; a negative or null label has no member."""

    def file_of(self, row: dict) -> str:
        return row["shard"]

    def fill(self, out, rows: Iterator[dict]) -> None:
        with tarfile.open(fileobj=out, mode="w|") as tar:
            for r in rows:
                parts = [(r["ext"], r["bytes"])]
                if r["label"] is not None and r["label"] >= 0:
                    parts.append(("cls", str(r["label"]).encode()))
                for ext, data in parts:
                    info = tarfile.TarInfo(f"{r['key']}.{ext}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))


def _scan(spark: SparkSession, pattern: str, **options) -> DataFrame:
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").options(path=pattern, **options).load()


def scan_tar_shards(
    spark: SparkSession, pattern: str, header_only: bool = False, where: Where = (), split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    header = str(header_only).lower()
    return _scan(spark, pattern, headerOnly=header, splitBytes=str(split_bytes), where=option(where))


def count_shard_entries(spark: SparkSession, pattern: str) -> DataFrame:
    """Images per shard from the tar headers alone."""
    return scan_tar_shards(spark, pattern, header_only=True).groupBy("shard").count().withColumnRenamed(
        "count", "n_images"
    )


def write_tar_shards(samples: DataFrame, root: str, order: str = "key") -> None:
    """Write (shard, key, ext, bytes, label) as one tar file for each shard, samples sorted by ``order``.

    All files appear when every task has ended; a failed job leaves none.
    """
    spark = samples.sparkSession
    spark.dataSource.register(TarShards)
    (
        samples.repartition("shard")
        .sortWithinPartitions("shard", order)
        .select("shard", "key", "ext", "bytes", F.col("label").cast("int").alias("label"))
        .write.format("tarshards")
        .option("path", root)
        .mode("append")
        .save()
    )


def write_indexes(spark: SparkSession, pattern: str, stretch: int = INDEX_ROWS) -> int:
    """Write an index beside every shard, one task for some shards each; the number of samples."""
    paths = expand(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                schema = pa.schema(list(_PLACES)[1:], metadata={"shard_bytes": str(size_of(path))})
                hidden, n = f"{path}{INDEX}-{uuid.uuid4().hex}", 0
                with open_output(hidden) as out, pq.ParquetWriter(out, schema) as index:
                    rows = places(path)
                    while part := list(islice(rows, stretch)):
                        columns = _batch(part, _PLACES).columns[1:]
                        index.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                        n += len(part)
                move(hidden, path + INDEX)
                yield pd.DataFrame({"n": [n]})

    tasks = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return todo.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fetch_targets(spark: SparkSession, pattern: str, targets: DataFrame) -> DataFrame:
    """The samples whose key is in ``targets`` (column ``key``): keys meet first, then images are read.

    The join sees the places of the members alone. Its rows are dealt out by shard and stretch of the
    shard, and each task seeks to the planned members, so no image that is not wanted is read or shuffled.
    """
    where = _scan(spark, pattern, places="true").join(targets.select("key").distinct(), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, raw = None, None
        try:
            for batch in batches:
                rows, held = [], 0
                for row in zip(*batch.to_pydict().values()):
                    if row[0] != path:
                        if raw is not None:
                            raw.close()
                        path, raw = row[0], open_file(row[0])
                    rows.append((posixpath.basename(path), row[1], row[2], row[3], *_load(raw, row, False)))
                    held += row[5]
                    if held >= BATCH_BYTES:
                        yield _batch(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _ARROW)
        finally:
            if raw is not None:
                raw.close()

    stretch = F.floor(F.col("at") / SPLIT_BYTES)
    names = [f.name for f in _PLACES]
    return where.repartition("path", stretch).sortWithinPartitions("path", "at").select(*names).mapInArrow(run, SCHEMA)


def stream_tar_shards(spark: SparkSession, pattern: str, log: str) -> DataFrame:
    """Samples of shards as they appear; ``log`` is the folder that records the shards of each trigger.

    The process that plans a Python stream sees none of the files sent to executors, so the source
    travels whole instead of by name.
    """
    with by_value(__name__, Conditions.__module__, StagedWriter.__module__, expand.__module__):
        spark.dataSource.register(TarShards)
        return spark.readStream.format("tarshards").options(path=pattern, log=log).load()
