"""Near-duplicate classes with fast similarity sketches.

A document is the set of its distinct five-word shingles. A sketch has 128 places and is filled in
rounds: in each of the first 128 rounds every shingle is hashed to a place with a value that grows
with the round, and a place keeps its smallest value; the rounds end when no place is empty. In a
later round i, all shingles compete for place i - 128, so that every place fills for certain. Places
agree with probability equal to the similarity, with the concentration of independent samples,
after about n + 128 log 128 hashes instead of 128 n.

1. Documents with the same set form a class, represented by its smallest id.
2. Representatives that agree on one of 25 bands of five places are candidates: a pair at 0.85
   is missed with a chance of 4e-7, one at 0.80 with 5e-5.
3. In each band bucket every member is held against the bucket's first one; verified links form
   components. Buckets whose members are still in several components are then compared whole, in
   cells of two blocks of bounded size: a task multiplies the incidence matrix of a cell with itself
   and returns the links that join components, at most one less than it has members.
4. Links count only where the full sets satisfy ``100 * intersection >= percent * union``; ``percent``
   is 85 in op9 and 80 in the corpus pipeline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import TABLES, stored, tidy, tidy_group
from tilewright.llm.components import components

WORDS, PERCENT = 5, 85
PLACES, BANDS, ROWS = 128, 25, 5
BLOCK = 1 << 20
#: Members of a block of a crowded bucket, rows of cells that a task gets at once, columns of a matrix.
BLOCK_MEMBERS, PART_ROWS, COLUMNS = 256, 1024, 8192

_U = np.uint64
_BASE = 0x2545F4914F6CDD1D
_rng = np.random.default_rng(11)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}
TABLES.append(_powers)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the bytes, and where each word starts."""
    gap = _GAP[data]
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=_U, out=c[1:])
    return _mixed((c[stop] - c[start]) * down[start] + (stop - start).astype(_U)), start


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each whole text as 64-bit hashes."""
    out: list[np.ndarray] = []
    lot: list[bytes] = []
    size = 0
    for t in texts:
        lot.append(t or b"")
        size += len(lot[-1]) + 1
        if size >= BLOCK:
            out += _lot_sets(lot, words)
            lot, size = [], 0
    return out + _lot_sets(lot, words)


def _lot_sets(lot: list[bytes], words: int) -> list[np.ndarray]:
    if not lot:
        return []
    data = np.frombuffer(b" ".join(lot), np.uint8)
    hashes, start = word_hashes(data)
    edges = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in lot)]))
    rolled = np.zeros(max(len(hashes) - words + 1, 0), _U)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _TURN[k]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(_mixed(np.array([(hashes[a:b] * _TURN[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def sketch(items: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The sketch of a non-empty set of hashes; ``places`` is a power of two."""
    shift, out = _U(65 - places.bit_length()), np.zeros(places, _U)
    empty = np.ones(places, bool)
    for i in range(2 * places):
        h = _mixed(items + _U(((i + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
        if i < places:
            h.sort()
            place = (h >> shift).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            place, h = place[first], h[first]
            new = empty[place]  # earlier rounds have smaller values
            out[place[new]] = h[new] ^ _U(i)
            empty[place] = False
            if not empty.any():
                break
        elif empty[i - places]:
            out[i - places] = h.min() ^ _U(i)
            empty[i - places] = False
    return out


def bands(s: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band."""
    grid = s[: n * rows].reshape(n, rows)
    key = (grid * _TURN[:rows]).sum(1, dtype=_U) + np.arange(n, dtype=_U) * _TURN[63]
    return _mixed(key).astype(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, key, bands)`` of each row; an empty set has null key and bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, known = [], [], {}
            sets = shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), words)
            for s in sets:
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if key is not None and key not in known:
                    known[key] = bands(sketch(s)).tolist()
                keys.append(key)
                rows.append(known.get(key))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary"))
    return rows.mapInArrow(tidy(sign), "doc_id long, n_shingles long, key binary, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, _U), np.frombuffer(q, _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            k = [i for i, t in enumerate(keep) if t]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in k], pa.int64()), pa.array([b[i] for i in k], pa.int64())], names=["a", "b"])

    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    whole = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(tidy(hold), "a long, b long")


def _joining_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each cell, links that join its components."""
    found: list[tuple[int, int]] = []
    for _, cell in group.groupby("cell", sort=False):
        sets = [np.frombuffer(x, _U) for x in cell["items"]]
        head, root = cell["head"].to_numpy(), cell["component"].to_numpy().copy()
        sizes = np.array([len(x) for x in sets])
        known, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(times > 1) - 1  # a shingle of one member is in no intersection
        row = np.repeat(np.arange(len(sets)), sizes)[times[place] > 1]
        column = rank[place[times[place] > 1]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
            inside = (column >= at) & (column < at + COLUMNS)
            x = np.zeros((len(sets), COLUMNS), np.float32)
            x[row[inside], column[inside] - at] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * union, 1))):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((int(head[i]), int(head[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "items"])

    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(make), "doc_id long, items binary").dropDuplicates(["doc_id"])


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``kept`` says
    that the row is that document. Rows without words link with nothing. A row whose id is null takes
    no part: its component is null and it is kept. Rows that share an id count as one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    signed = stored(signatures(rows, words=words), "signatures")
    inside = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    heads = stored(
        inside.groupBy("key").agg(F.min("doc_id").alias("head"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "heads",
    )
    members = heads.select("head", "n", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min_by(F.struct("head", "n"), "head").alias("first"), F.count("*").alias("size")).where("size > 1")
    close = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # no other sizes reach the similarity
    starred = members.join(crowded, "bucket").select("bucket", "head", "n", F.col("first.head").alias("lead"), F.col("first.n").alias("m"))
    in_bucket = stored(starred, "buckets")
    pairs = stored(in_bucket.where((F.col("head") != F.col("lead")) & close).select(F.col("lead").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    sets = stored(_sets(rows, in_bucket.select(F.col("head").alias("doc_id")).distinct(), words), "sets")
    links = stored(_verified(pairs, sets, percent), "links")
    labels = components(links)

    # members of one bucket that are still in different components
    placed = in_bucket.join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "bucket", "head", F.coalesce("component", "head").alias("component")
    )
    apart = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high and size > 2")
    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS)
    mine = F.pmod(F.xxhash64("head"), blocks)
    cells = stored(
        placed.join(apart.select("bucket", "size"), "bucket")
        .select("bucket", "head", "component", mine.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
        .select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "head", "component"),
        "cells",
    )
    n = cells.count()
    if n:
        dealt = cells.join(sets.select(F.col("doc_id").alias("head"), "items"), "head")
        part = F.pmod(F.xxhash64("cell"), F.lit(-(-n // PART_ROWS)))
        further = stored(dealt.groupBy(part.alias("part")).applyInPandas(tidy_group(lambda g: _joining_links(g, percent)), "a long, b long"), "links")
        if not further.isEmpty():
            labels = components(labels.toDF("a", "b").union(further))

    named = heads.select("key", "head").join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "key", F.coalesce("component", "head").alias("class")
    )
    lowest = signed.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id")
    )
    return lowest.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each class; the columns stay as they are. Rows that share an id count as one."""
    found = classes(docs, percent=percent).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(found, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1")
    if not repeated.isEmpty():
        known = known.dropDuplicates(["doc_id"])
    return known.unionByName(docs.where(F.col("doc_id").isNull()))
