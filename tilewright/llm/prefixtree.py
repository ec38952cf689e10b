"""Set similarity join of word n-grams over prefix trees.

A document is the set of its distinct shingles; equal sets form a class that is represented by its
smallest id. All sets are put in one global order, rare shingles first: shingles are hashed to
counters, a row adds one to the counter of each of its shingles, and the order is (counter class,
hash). Any fixed order is right; this one keeps passages that many documents share out of what follows.

1. Two sets that are similar enough share one of the first ``n - need + 1`` shingles of either, ``need``
   being the least overlap that a set of n can have with a partner. Each such shingle that several
   sets have gets a home, the smallest id among them, and a set goes to the distinct homes of its
   shingles. Two partners share a shingle, so they meet at its home; near copies mostly share homes,
   so a set travels to few of them.
2. The sets of a home are cut into blocks of bounded size, and its first sets are put in every block. First
   their parity bitmaps meet: two sets differ in at least as many members as their bitmaps differ in
   bits, so a set that is too far from all others of its block stays behind, and only the
   others are sent whole. A block's sets are stored in a prefix tree. It is walked once for all sets at a time: a node carries the
   partial overlap of every set that is still in question, shared by all leaves below, and a set leaves a
   subtree when the overlap so far plus the smaller remaining length cannot reach the least overlap
   needed there. Only links that join components are returned.
3. Homes whose sets are still in several components are walked again, two blocks at a time, so that
   every two sets of a home meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored
from tilewright.llm.components import components
from tilewright.llm.neardup import shingle_sets

WORDS, PERCENT = 3, 90
#: One counter for so many expected shingles, and the most counters (a broadcast byte each).
PER_COUNTER, COUNTERS = 128, 1 << 22
#: Counters of a slice that travels by itself.
SLICE = 1 << 16
#: Sets and shingles of a block, sets of a home that every block holds, rows that a task gets at once.
MEMBERS, SHINGLES, LEADS, PART_ROWS = 512, 1 << 17, 16, 256
#: Bits of the smallest and the largest parity bitmap, rows of bitmaps that are held against each other at once.
LEAST_BITS, MOST_BITS, NEAR_ROWS = 64, 8192, 512

_U = np.uint64
_LOW = _U((1 << 56) - 1)


def rarity(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """The class of each counter: four steps for each doubling of its count, over all rows."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(max((size // 6 // PER_COUNTER).bit_length(), 8), COUNTERS.bit_length() - 1)
    n = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for part in _slices(b, 0):
                for s in shingle_sets(part.column(0).to_pylist(), words):
                    np.add.at(total, (s >> _U(64 - bits)).astype(np.int64), 1)
        at = [a for a in range(0, n, SLICE) if total[a : a + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([_bytes(total[a : a + SLICE]) for a in at], pa.binary())], names=["at", "counts"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "counts": [_bytes(sum(_numbers(c) for c in group["counts"]))]})

    # partial sums of a few tasks first, so that no task reads a slice of all of them
    parts = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary")).mapInArrow(count, "at long, counts binary")
    few = parts.withColumn("few", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = few.groupBy("at", "few").applyInPandas(lambda k, g: add(k, g), "at long, counts binary").groupBy("at").applyInPandas(add, "at long, counts binary")
    total = np.zeros(n, np.int64)
    for r in sums.collect():  # at most COUNTERS numbers
        c = _numbers(r.counts)
        total[r["at"] : r["at"] + len(c)] = c
    return np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)


def _bytes(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<i8").tobytes(), 1)


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), "<i8")


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    per = max(1, int(b.num_rows * (1 << 20) / max(b.column(column).nbytes, 1)))
    for at in range(0, b.num_rows, per):
        yield b.slice(at, per)


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order, as numbers that sort so: class, then hash."""
    bits = len(classes).bit_length() - 1
    return np.unique((classes[(s >> _U(64 - bits)).astype(np.int64)].astype(_U) << _U(56)) | (s & _LOW))


def least_overlap(a, b, percent: int):
    """The smallest overlap of sets of ``a`` and ``b`` members with ``100 * overlap >= percent * union``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How many first members of a set of ``n`` surely hold one that a partner has."""
    return n + (-percent * n // 100) + 1


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: a bit says whether an odd number of members fell on it; half a bit to one for a member."""
    bits = min(max(1 << (len(s) // 2).bit_length(), LEAST_BITS), MOST_BITS)
    return (np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def _folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bitmap.reshape(-1, bits), axis=0)


def plausible(cell: np.ndarray, component: np.ndarray, size: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows have another one in their cell that is not too far for a link, in another component."""
    keep = np.zeros(len(cell), bool)
    width = np.array([len(x) for x in bitmaps])
    for bits in np.unique(width).tolist():
        mine, wider = np.flatnonzero(width == bits), np.flatnonzero((width >= bits) & (size * percent <= 100 * size[width == bits].max()))
        a = 1 - 2 * np.stack([bitmaps[i] for i in mine]).astype(np.float32)
        b = 1 - 2 * np.stack([_folded(bitmaps[i], bits) for i in wider]).astype(np.float32)
        differ = (bits - (a @ b.T)) / 2  # whole numbers below 2**24 are exact
        both = size[mine][:, None] + size[wider][None, :]
        near = (differ <= both - 2 * least_overlap(both, 0, percent)) & (cell[mine][:, None] == cell[wider][None, :])
        near &= component[mine][:, None] != component[wider][None, :]
        near &= 100 * np.minimum(size[mine][:, None], size[wider][None, :]) >= percent * np.maximum(size[mine][:, None], size[wider][None, :])
        keep[mine[near.any(axis=1)]] = True
        keep[wider[near.any(axis=0)]] = True
    return keep


class Tree:
    """Ordered sets in a prefix tree, walked for all of them at once.

    The tree is kept as the sets in lexicographic order and the lengths of the prefixes that neighbours share: a
    node is a run of sets and a depth, and an edge is a stretch of members without a branch.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order, chosen = order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in chosen], np.int64)
        self.known, place, times = np.unique(np.concatenate(chosen), return_inverse=True, return_counts=True)
        self.edge = np.concatenate([[0], self.size.cumsum()])
        self.rank = place.astype(np.int64)
        # members of one set alone overlap with nothing: all share the last, empty row
        shared = np.cumsum(times > 1) - 1
        n = int(shared[-1]) + 1
        row = np.where(times > 1, shared, n)
        self.row = row[place]
        owner = np.repeat(np.arange(len(chosen)), self.size)
        self.holds = np.zeros((n + 1, len(chosen)), np.uint8)
        self.holds[self.row, owner] = 1
        self.holds[n] = 0
        self.flat = owner * len(self.known) + self.rank
        self.common = np.zeros(len(chosen), np.int64)  # with the set before
        for i in range(1, len(chosen)):
            a, b = chosen[i - 1], chosen[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def _step(self, low: int, high: int, at: int, to: int, active: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks an edge of the run ``[low, high)`` in growing strides; sets that cannot qualify leave."""
        longest, shortest = int(self.size[low:high].max()), int(self.size[low:high].min())
        need = least_overlap(self.size[active], shortest, self.percent)
        stride = 16
        while len(active) and at < to:
            end = min(at + stride, to)
            here = slice(self.edge[low] + at, self.edge[low] + end)
            overlap = overlap + self.holds[self.row[here]][:, active].sum(axis=0, dtype=np.int64)
            passed = np.searchsorted(self.flat, active * len(self.known) + self.rank[here.stop - 1], side="right") - self.edge[active]
            left = np.minimum(self.size[active] - passed, longest - end)
            stay = overlap + left >= need
            active, overlap, need = active[stay], overlap[stay], need[stay]
            at, stride = end, 2 * stride
        return active, overlap

    def links(self, component: list[int] | None = None) -> list[tuple[int, int]]:
        """Links between sets, as places in the list given; with components only those that join two of them."""
        root = None if component is None else np.array([component[i] for i in self.order])
        found: list[tuple[int, int]] = []
        every = np.arange(len(self.order))
        todo = [(0, len(self.order), 0, every, np.zeros(len(self.order), np.int64))]
        while todo:
            low, high, depth, active, overlap = todo.pop()
            stay = active > low  # a link is found once, from the earlier leaf
            if root is not None and (root[low:high] == root[low]).all():
                stay &= root[active] != root[low]
            active, overlap = active[stay], overlap[stay]
            end = int(self.size[low]) if high - low == 1 else int(self.common[low + 1 : high].min())
            active, overlap = self._step(low, high, depth, end, active, overlap)
            if not len(active):
                continue
            if high - low == 1:
                for x in active[overlap >= least_overlap(self.size[active], self.size[low], self.percent)].tolist():
                    if root is None or root[x] != root[low]:
                        found.append((self.order[low], self.order[x]))
                        if root is not None:
                            root[root == root[x]] = root[low]
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1 : high] == end)).tolist(), high]
            todo += [(a, b, end, active, overlap) for a, b in zip(cuts, cuts[1:])]
        return found


def _near(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of each cell that have a plausible partner; small cells are held against themselves together."""
    group = group.sort_values(["cell", "head"], kind="stable").drop_duplicates(["cell", "head", "n", "bits"])
    cell = group["cell"].to_numpy()
    edges = [*np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)).tolist(), len(cell)]
    keep, start = [], 0
    for a, b in zip(edges, edges[1:]):
        if b - start >= NEAR_ROWS or b == len(cell):
            part = group.iloc[start:b]
            bitmaps = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in part["bits"]]
            keep.append(plausible(part["cell"].to_numpy(), part["component"].to_numpy(), part["n"].to_numpy(), bitmaps, percent))
            start = b
    return group.loc[np.concatenate(keep), ["cell", "head", "component", "n"]].drop_duplicates(["cell", "head"])


def _walk(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each cell, links that join its components."""
    found: list[tuple[int, int]] = []
    for _, cell in group.groupby("cell", sort=False):
        cell = cell.drop_duplicates(["head", "items"])
        head = cell["head"].tolist()
        tree = Tree([np.frombuffer(x, _U) for x in cell["items"]], percent)
        found += [(head[a], head[b]) for a, b in tree.links(cell["component"].tolist())]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def signatures(docs: DataFrame, classes: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n, key, prefix, bits)`` of every row; an empty set has a null key."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                sizes, keys, prefixes, bits = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    s = ordered(s, known.value)
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    prefixes.append(s[: prefix_length(len(s), percent)].astype(np.int64) if len(s) else [])
                    bits.append(np.packbits(parity(s)).tobytes() if len(s) else b"")
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "prefix", "bits"])

    return docs.mapInArrow(sign, "doc_id long, n long, key binary, prefix array<long>, bits binary")


def _sets(docs: DataFrame, heads: DataFrame, classes: np.ndarray, words: int) -> DataFrame:
    """``(head, key, items)`` of every row whose id is a head, with the key of its set."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                sets = [ordered(s, known.value).tobytes() for s in shingle_sets(part.column(1).to_pylist(), words)]
                columns = [part.column(0), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "key", "items"])

    return docs.join(heads.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(make, "head long, key binary, items binary")


def _dealt(cells: DataFrame, weight: str, most: int, rows: int) -> DataFrame:
    """``cells`` with a ``part``: whole cells, about ``rows`` rows and a bounded weight for each."""
    whole = cells.agg(F.count("*"), F.sum(weight)).first()
    parts = max(1, -(-whole[0] // rows), -(-(whole[1] or 0) // most))
    return cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)))


def _joined(cells: DataFrame, rows: DataFrame, heads: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """The links that join components, found in ``cells (cell, head, component, n)``."""
    light = _dealt(cells, "n", 16 * SHINGLES, 4 * PART_ROWS).drop("n").join(heads.select("head", "n", "bits"), "head")
    near = light.groupBy("part").applyInPandas(lambda g: _near(g, percent), "cell long, head long, component long, n long")
    near = stored(near, "near")
    sets = stored(_sets(rows, near, classes, words).join(heads.select("key", "head"), ["key", "head"], "left_semi").select("head", "items").distinct(), "sets")
    heavy = _dealt(near, "n", 2 * SHINGLES, PART_ROWS).select("part", "cell", "head", "component").join(sets, "head")
    return stored(heavy.groupBy("part").applyInPandas(lambda g: _walk(g, percent), "a long, b long"), "links")


def join(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    members: int = MEMBERS, shingles: int = SHINGLES, leads: int = LEADS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row.

    ``component_id`` is the smallest id reachable over links, the row's own included. A text with fewer
    words than a shingle is one shingle; one without words, or null, links with nothing. A row whose
    id is null takes no part and has no component. Rows that share an id are one document: all
    their sets reach its component. An empty table gives no rows; extra columns are left aside.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    classes = rarity(rows, "text", words)
    signed = stored(signatures(rows, classes, words, percent), "signatures")
    inside = signed.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    # a set is named by its smallest id; ids that repeat may stand for several sets
    heads = stored(inside.groupBy("key").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "heads")
    entries = heads.select("head", F.explode("prefix").alias("token"))
    tokens = entries.groupBy("token").agg(F.min("head").alias("home"), F.count("*").alias("size")).where("size > 1").drop("size")
    homes = stored(entries.join(tokens, "token").select("home", "head").distinct(), "homes").join(heads.select("head", "n").groupBy("head").agg(F.max("n").alias("n")), "head")
    wide = homes.groupBy("home").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / members), F.ceil(F.col("weight") / shingles)).cast("int")
    placed = stored(homes.join(wide, "home").withColumn("blocks", F.least(blocks, "size")).withColumn("block", F.pmod(F.xxhash64("head", "home"), "blocks").cast("int")), "placed")
    rank = F.row_number().over(Window.partitionBy("home").orderBy("head"))
    first = placed.where("blocks > 1").withColumn("rank", rank).where(F.col("rank") <= leads)
    everywhere = first.select("home", "head", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocked = placed.select("home", "head", "n", "block").unionByName(everywhere.select("home", "head", "n", "block")).distinct()
    links = _joined(blocked.select(F.xxhash64("home", "block").alias("cell"), "head", F.col("head").alias("component"), "n"), rows, heads, classes, words, percent)
    labels = components(links)

    named = placed.where("blocks > 1").join(labels.withColumnRenamed("node", "head"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    apart = named.groupBy("home").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("home")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = named.join(apart, "home").select("home", "head", "component", "n", "block", other).where("block <> other")
    cell = F.xxhash64("home", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    cells = stored(pairs.select(cell, "head", "component", "n"), "cells")
    mixed = cells.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cell")
    if not cells.isEmpty():
        further = _joined(cells.join(mixed, "cell"), rows, heads, classes, words, percent)
        labels = components(labels.toDF("a", "b").union(further))

    classed = heads.select("key", "head").join(labels.withColumnRenamed("node", "head"), "head", "left").select("key", F.coalesce("component", "head").alias("component_id"))
    mine = signed.join(classed, "key", "left")
    return mine.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * common >= 90 * (n + m - common)),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.seen), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
