"""Exact top-k search by inner product with no-random-access aggregation.

Vectors become integers and are packed into blocks. A block keeps, for each component, its rows sorted
by that component (a sorted list). For a query, each list is read from the end where the component
helps most, in steps. A row's lower bound counts what has been read of it and the list's worst value
for the rest; its upper bound counts the list's current value for the rest. Reading stops when the
k-th largest lower bound is at least the upper bound of every other row, or few rows can still
qualify; the final scores of the rows that can are then resolved. The best of each block are merged.

Query blocks meet vector blocks on a grid of cells with a bounded number of either. In a cell, a query
carries the k-th score found so far from one vector block to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored

K, EVERY, SCALE = 5, 50, 256
#: Vectors of a block, queries of a block, vector and query blocks of a grid cell; rows that are resolved without reading on.
VECTORS, QUERIES, GROUP, LOT, RESOLVE = 4096, 256, 4, 16, 512
#: Parts of a list that are read in one step.
STEPS = (0.5, 0.65, 0.8, 0.9)
#: Scores are 64-bit numbers; components beyond this (before scaling) count as this, since no score of theirs is one.
LARGEST = float(1 << 54)

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Block:
    """Vectors with a sorted list for each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.n = len(ids)
        self.sorted = np.sort(self.vectors, axis=0)
        rank = np.argsort(np.argsort(self.vectors, axis=0, kind="stable"), axis=0, kind="stable")
        self.rank = rank.astype(np.int16 if self.n < 1 << 15 else np.int32)  # from the smallest
        # single precision is exact while all sums stay below 2**24
        self.top = top = int(np.abs(self.vectors).max(initial=0))
        self.single = vectors.shape[1] * top * top < 1 << 24
        self.floats = self.vectors.astype(np.float32 if self.single else np.float64)

    def search(self, query: np.ndarray, own: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of up to k best rows; rows that cannot reach ``floor`` may be missing."""
        if self.top * int(np.abs(query).max(initial=0)) * len(query) >= 1 << 53:  # bounds in float64 would not be exact
            return self._resolved(np.flatnonzero(self.ids != own), query, k)
        kind = np.float32 if self.single and np.abs(query).max(initial=0) <= 4096 else np.float64
        slack = 0.5 if kind == np.float64 else 1.0 + 1e-5 * float(np.abs(query.astype(np.float64)).sum() * np.abs(self.sorted[[0, -1]]).max(initial=0))
        q = query.astype(kind)
        up = query >= 0
        worst = np.where(up, self.sorted[0], self.sorted[-1]).astype(kind) * q
        alive, x, place = np.arange(self.n), self.floats, np.where(up, self.n - 1 - self.rank, self.rank)
        for part in STEPS:
            depth = max(1, int(part * self.n))
            if len(alive) <= max(RESOLVE, k + 1):
                break
            edge = np.where(up, self.sorted[self.n - depth], self.sorted[depth - 1]).astype(kind) * q
            read = (place < depth).astype(kind)  # what sequential access has seen by now
            known, seen = (x * read) @ q, read @ np.stack([worst, edge], axis=1)
            lower, upper = known + worst.sum() - seen[:, 0], known + edge.sum() - seen[:, 1]
            lower[self.ids[alive] == own] = -np.inf
            bound = np.partition(lower, len(lower) - k)[len(lower) - k] - slack
            keep = np.flatnonzero(upper + slack >= max(bound, float(floor) if floor > _LEAST else -np.inf))
            alive, x, place = alive[keep], x[keep], place[keep]
        return self._resolved(alive[self.ids[alive] != own], query, k)

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these rows by their final scores; sums beyond 64 bits are made with whole numbers of any size."""
        if self.top * int(np.abs(query).max(initial=0)) * len(query) < 1 << 63:
            scores = self.vectors[rows] @ query
        else:
            exact = self.vectors[rows].astype(object) @ query.astype(object)
            scores = np.array([min(max(x, _LEAST + 1), _MOST) for x in exact], np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def whole_numbers(vectors: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with floor(scale * x); vectors that are null or hold no finite number somewhere are left out, an empty one is all zeros."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) * scale))
    return vectors.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows: ``(block, ids, data, width)``; a task packs what it has, so nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        vectors: list[list[int]] = []

        def out() -> pa.RecordBatch:
            nonlocal ids, vectors, n
            width = max(1, *map(len, vectors))
            data = np.zeros((len(ids), width), np.int64)  # missing components count as 0
            for i, v in enumerate(vectors):
                data[i, : len(v)] = v
            if np.abs(data).max() < 1 << 31:
                data = data.astype(np.int32)
            columns = [pa.array([task + n]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([width])]
            ids, vectors, n = [], [], n + 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "data", "width"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield out()
        if ids:
            yield out()

    return rows.mapInArrow(pack, "block long, ids binary, data binary, width long")


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    kind = np.int32 if len(row.data) == 4 * len(ids) * row.width else np.int64
    return ids, np.frombuffer(row.data, kind).reshape(len(ids), row.width).astype(np.int64)


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", size: int = VECTORS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each query, ties to the smaller id.

    Rows of equal ids are the same row for a query of that id. Vectors of different lengths are filled
    up with zeros. Repeated rows are returned as often as they occur. Without vectors or queries there
    are no rows.
    """
    base = stored(_packed(whole_numbers(vectors, id_col, vector), size), "blocks")
    asked = stored(_packed(whole_numbers(queries, id_col, vector), QUERIES), "queries")
    parts = max(1, -(-base.count() // GROUP))
    lots = max(1, -(-asked.count() // LOT))
    over = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell))
    place = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    lot = F.pmod(F.xxhash64("block"), F.lit(lots)).cast("int")
    base = base.withColumn("cell", over(lots, lambda i: place * lots + i))
    sent = asked.withColumn("cell", over(parts, lambda i: i * lots + lot))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        texts = [(r.block, *_read(r)) for r in right.itertuples()]
        for row in left.itertuples():
            ids, data = _read(row)
            width = max([data.shape[1], *(q.shape[1] for _, _, q in texts)])
            block = Block(ids, _fit(data, width))
            for n, q_ids, q in texts:
                for i, (own, query) in enumerate(zip(q_ids.tolist(), _fit(q, width))):
                    best = found.setdefault((n, i), [])
                    at, scores = block.search(query, own, k, best[k - 1][0] if len(best) >= k else _LEAST)
                    best += zip(scores.tolist(), block.ids[at].tolist())
                    best.sort(key=lambda x: (-x[0], x[1]))
                    del best[k:]
        names = {(n, i): own for n, q_ids, _ in texts for i, own in enumerate(q_ids.tolist())}
        rows = [(names[q], q[0], q[1], v, s) for q, best in found.items() for s, v in best]
        return pd.DataFrame(rows, columns=["query_id", "block", "row", "vec_id", "score"])

    schema = "query_id long, block long, row long, vec_id long, score long"
    near = base.groupBy("cell").cogroup(sent.groupBy("cell")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
