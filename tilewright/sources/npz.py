"""``spark.read.format("npz")``: legacy array files, one input partition per file.

``kind=patch`` reads slide files (X, y, names, patient, slide), ``kind=crops`` those with one
vector for each crop of a patch (X of three axes), ``kind=block`` external blocks (X, label_int,
patch_uid, model_key, ...).

Conditions on the file open no other file; those on patient, slide or model key read two small arrays of a file
before its vectors; those on the columns of a row pick rows. ``write_npz`` writes slide files.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from tilewright.sources.conditions import Conditions, Where, option
from tilewright.sources.files import expand, open_file
from tilewright.sources.staging import StagedWriter

SCHEMAS = {
    "patch": "file string, patient string, slide string, name string, label smallint, x array<float>",
    "crops": "file string, patient string, slide string, name string, label smallint, x array<array<float>>",
    "block": "file string, model_key string, patch_uid string, label_int smallint, x array<float>",
}
CHUNK = 1024
#: Column of the table and array of the file: one value for a file, one for a row.
WHOLE = {"patch": {"patient": "patient", "slide": "slide"}, "block": {"model_key": "model_key"}}
ROWS = {"patch": {"name": "names", "label": "y"}, "block": {"patch_uid": "patch_uid", "label_int": "label_int"}}
WHOLE["crops"], ROWS["crops"] = WHOLE["patch"], ROWS["patch"]


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class NpzSource(DataSource):
    """Options: ``path`` (glob), ``kind``, ``allowPickle`` (names stored as objects), ``where`` (conditions)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _kind(self) -> str:
        kind = self.options.get("kind", "patch")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown npz kind {kind!r}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> DataSourceReader:
        pickled = self.options.get("allowPickle", "false").lower() == "true"
        return NpzReader(self.options["path"], self._kind(), pickled, self.options.get("where", "[]"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("array files are only appended; a file of the same name is replaced")
        return NpzWriter(self.options["path"])


class NpzReader(DataSourceReader):
    def __init__(self, pattern: str, kind: str, pickled: bool, where: str = "[]"):
        self.pattern, self.kind, self.pickled = pattern, kind, pickled
        self.where = Conditions(where, {"file", *WHOLE[kind], *ROWS[kind]})

    def partitions(self) -> list[FilePartition]:
        paths = expand(self.pattern)
        if not paths:
            raise FileNotFoundError(f"no files match {self.pattern}")
        wanted = [p for p in paths if self.where.passes("file", posixpath.basename(p))]
        return [FilePartition(p) for p in wanted] or [FilePartition("")]

    def read(self, partition: FilePartition):
        if not partition.path:
            return
        slide = ("X", "y", "names", "patient", "slide")
        need = {"patch": slide, "crops": slide, "block": ("X", "label_int", "patch_uid", "model_key")}
        with open_file(partition.path) as f, np.load(f, allow_pickle=self.pickled) as d:
            missing = set(need[self.kind]) - set(d.files)
            if missing:
                raise KeyError(f"{partition.path}: missing arrays {sorted(missing)}")
            whole = {c: d[k] for c, k in WHOLE[self.kind].items()}
            if not all(self.where.passes(c, str(v.item())) for c, v in whole.items()):
                return
            arrays = {k: d[k] for k in need[self.kind]}
        x = np.asarray(arrays["X"], dtype=np.float32)
        lengths = {len(arrays[k]) for k in need[self.kind][:3]}
        if x.ndim != (3 if self.kind == "crops" else 2) or len(lengths) != 1:
            raise ValueError(f"{partition.path}: array lengths disagree")
        keep = self._kept_rows(arrays)
        if keep is not None:
            x = x[keep]
            arrays |= {k: arrays[k][keep] for k in need[self.kind][1:3]}
        name = posixpath.basename(partition.path)
        for a in range(0, len(x), CHUNK):
            part = slice(a, min(a + CHUNK, len(x)))
            yield self._batch(name, arrays, x[part], part)

    def _kept_rows(self, arrays: dict) -> np.ndarray | None:
        """The rows that the conditions let through, None for all."""
        keep = None
        for column, k in ROWS[self.kind].items():
            if self.where.tests.get(column):
                read = int if column.startswith("label") else str
                passed = np.array([self.where.passes(column, read(v)) for v in arrays[k]], dtype=bool)
                keep = passed if keep is None else keep & passed
        return keep

    def _batch(self, name: str, arrays: dict, x: np.ndarray, part: slice) -> pa.RecordBatch:
        n = len(x)
        vectors = pa.array(np.ascontiguousarray(x).ravel(), pa.float32())
        for axis in range(x.ndim - 1, 0, -1):
            offsets = np.arange(0, len(vectors) + 1, x.shape[axis], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(offsets, vectors)

        def text(k: str) -> pa.Array:
            return pa.array([str(v) for v in arrays[k][part]], pa.string())

        def same(k: str) -> pa.Array:
            return pa.array([str(arrays[k].item())] * n, pa.string())

        files = pa.array([name] * n, pa.string())
        if self.kind != "block":
            cols = {
                "file": files,
                "patient": same("patient"),
                "slide": same("slide"),
                "name": text("names"),
                "label": pa.array(arrays["y"][part].astype(np.int16)),
                "x": vectors,
            }
        else:
            cols = {
                "file": files,
                "model_key": same("model_key"),
                "patch_uid": text("patch_uid"),
                "label_int": pa.array(arrays["label_int"][part].astype(np.int16)),
                "x": vectors,
            }
        return pa.RecordBatch.from_pydict(cols)


class NpzWriter(StagedWriter):
    """Rows (patient, slide, name, label, x), those of a slide in one run; a file holds a slide."""

    def file_of(self, row: dict) -> str:
        return f"{row['patient']}_{row['slide']}.npz"

    def fill(self, out, rows: Iterator[dict]) -> None:
        held = list(rows)
        buf = io.BytesIO()
        np.savez(
            buf,
            X=np.array([r["x"] for r in held], dtype=np.float32),
            y=np.array([r["label"] for r in held], dtype=np.int16),
            names=np.array([r["name"] for r in held]),
            patient=np.array(held[0]["patient"]),
            slide=np.array(held[0]["slide"]),
        )
        out.write(buf.getvalue())


def write_npz(patches: DataFrame, root: str) -> None:
    """Write (patient, slide, name, label, x) as one array file for each slide, rows by name.

    All files appear when every task has ended; a failed job leaves none.
    """
    patches.sparkSession.dataSource.register(NpzSource)
    (
        patches.select("patient", "slide", "name", "label", "x")
        .repartition("patient", "slide")
        .sortWithinPartitions("patient", "slide", "name")
        .write.format("npz")
        .option("path", root)
        .mode("append")
        .save()
    )


def scan_npz(spark: SparkSession, pattern: str, kind: str = "patch", allow_pickle: bool = False, where: Where = ()) -> DataFrame:
    spark.dataSource.register(NpzSource)
    return (
        spark.read.format("npz")
        .option("path", pattern)
        .option("kind", kind)
        .option("allowPickle", str(allow_pickle).lower())
        .option("where", option(where))
        .load()
    )
