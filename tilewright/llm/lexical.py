"""Exact ranked lexical search by dense blocked matrix products.

1. The terms of the items make a vocabulary. One pass over the documents keeps, of each whole text, its
   number of terms and how often each vocabulary term occurs; the document frequencies, the number
   of documents and of terms follow from that table.
2. In a task, documents are taken in tiles. A tile's impact matrix has a column for each vocabulary term
   that occurs in the tile (compact) and holds weight * saturation in float64; the item matrix has
   ones where an item holds the term. Their product is the tile's scores. Column tiles are so narrow
   that every partial sum stays below 2^53, where float64 is exact; they are added up in 64-bit integers.
3. A task keeps the k best documents of each item: what reaches the k-th score so far, ties
   included, is a candidate, and candidates are cut to k by (score, id) now and then. The best of
   the tasks are ranked by one window over at most k rows for each task and item.

Items are taken in lots of bounded size, by their number of terms; only a lot's terms and counts pass
through the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored

K = 50
#: (item, term) pairs of a lot, documents and items and columns of a tile, bytes of text that are cut at once.
PAIRS, DOCS, ITEMS, COLUMNS, BYTES = 1 << 18, 512, 256, 2048, 1 << 20
#: Float64 holds every whole number below this.
EXACT = 1 << 53

#: Terms of UTF-8 bytes whose ASCII capitals are lower-cased: ASCII letters and figures, and all that is not ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a whole text; long texts are cut between terms."""
    low, at, out = text.lower(), 0, Counter()
    while at < len(low):
        to = at + BYTES
        while to < len(low) and _TERM.match(low, to):
            to = _TERM.match(low, to).end()
        out.update(_TERM.findall(low, at, to))
        at = to
    return out


def item_terms(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term)``, once each; rows that share an id, or have none, are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [list(term_counts(t)) for t in b.column(1).to_pylist()]
            ids = np.repeat(np.arange(b.num_rows), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array([t for ts in terms for t in ts], pa.binary())], names=["item_id", "term"])

    rows = items.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text).cast("binary"))
    return rows.mapInArrow(cut, "item_id long, term binary").distinct()


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, times)`` of every row that has a term: its number of terms, and its vocabulary terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most PAIRS terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = known.value
        for b in batches:
            per = max(1, int(b.num_rows * BYTES / max(b.column(1).nbytes, 1)))
            for at in range(0, b.num_rows, per):
                part, keep, sizes, terms, times = b.slice(at, per), [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    counts = term_counts(t)
                    if counts:
                        keep.append(i)
                        sizes.append(sum(counts.values()))
                        here = counts.keys() & look.keys()
                        terms.append([look[x] for x in here])
                        times.append([counts[x] for x in here])
                columns = [part.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "times"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Scorer:
    """Scores tiles of documents for a lot of items."""

    def __init__(self, n_items: int, item: np.ndarray, term: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """``item`` and ``term`` are the pairs of the lot."""
        order = np.argsort(term, kind="stable")
        self.n_items, self.item = n_items, item[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        top = int(weights.max(initial=1)) * 10**6  # no impact is larger
        self.columns = max(1, min(COLUMNS, (EXACT - 1) // max(top, 1)))

    def impacts(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        lengths = np.array([50 + 50 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        return self.weights[term] * ((10**9 * times) // (1000 * times + 20 * lengths[row]))

    def tile(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The scores (items x documents) of one tile of documents."""
        present, column = np.unique(term, return_inverse=True)
        impact = self.impacts(n, row, term, times).astype(np.float64)
        scores = np.zeros((self.n_items, len(n)), np.int64)
        for at in range(0, len(present), self.columns):
            here = present[at : at + self.columns]
            inside = (column >= at) & (column < at + self.columns)
            docs = np.zeros((len(here), len(n)))
            docs[column[inside] - at, row[inside]] = impact[inside]
            sizes = self.first[here + 1] - self.first[here]
            place = np.repeat(np.arange(len(here)), sizes)
            item = self.item[np.arange(len(place)) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat(self.first[here], sizes)]
            for low in range(0, self.n_items, ITEMS):
                mine = (item >= low) & (item < low + ITEMS)
                ones = np.zeros((min(ITEMS, self.n_items - low), len(here)))
                ones[item[mine] - low, place[mine]] = 1.0
                scores[low : low + ITEMS] += (ones @ docs).astype(np.int64)
        return scores


class Best:
    """The k best documents of each item, ties to the smaller id and null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.limit = k, 4 * n_items * k + 65536
        self.floor = np.ones(n_items, np.int64)  # a score must be above 0
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no id, id
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def offer(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.waiting.append([item, scores[item, doc], missing[doc], ids[doc]])
        self.size += len(item)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """Keeps the k best of each item."""
        item, score, missing, ids = (np.concatenate([a, *(w[i] for w in self.waiting)]) for i, a in enumerate(self.kept))
        order = np.lexsort((ids, missing, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        self.kept = [a[order[rank < self.k]] for a in (item, score, missing, ids)]
        last = order[rank == self.k - 1]
        self.floor[item[last]] = score[last]
        self.waiting, self.size = [], 0
        return self.kept


def _lot(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    known = pairs.collect()  # bounded: the terms of a lot of items
    items = sorted({r.item_id for r in known}, key=lambda i: (i is None, i or 0))
    vocabulary: dict[bytes, int] = {}
    place = {i: n for n, i in enumerate(items)}
    item = np.array([place[r.item_id] for r in known], np.int64)
    term = np.array([vocabulary.setdefault(bytes(r.term), len(vocabulary)) for r in known], np.int64)
    found = stored(occurrences(docs, vocabulary), "occurrences")
    total = found.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    df = {r.term: r.df for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = np.array([weight(total.n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    plan = spark.sparkContext.broadcast((items, Scorer(len(items), item, term, weights, total.n_docs, total.n_terms or 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scorer = plan.value
        best = Best(len(names), k)
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                ids, n = part.column(0), part.column(1).to_numpy()
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), sizes)
                terms, times = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.offer(scorer.tile(n, row, terms, times), missing, ids.fill_null(0).to_numpy())
        item, points, missing, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([names[i] for i in item.tolist()], pa.int64()), pa.array(ids, mask=missing.astype(bool)), pa.array(points)],
            names=["item", "item_id", "doc_id", "score"],
        )

    near = found.mapInArrow(score, "item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, pairs_per_lot: int = PAIRS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item with a score above 0.

    Equal scores go by ascending id, null ids last. Every row is a document: rows that repeat an id or
    a text are ranked one by one. Items without a term, and documents without one, have no rows, nor
    has an empty table on either side. Extra columns are left aside.
    """
    pairs = stored(item_terms(items), "item-terms")
    lots = max(1, -(-pairs.count() // pairs_per_lot))
    lot = F.pmod(F.xxhash64("item_id"), F.lit(lots))
    out = None
    for i in range(lots):
        mine = _lot(docs, pairs.where(lot == i), k)
        out = mine if out is None else out.union(mine)
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
t AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), total),
s AS (
  SELECT q.item_id, t.rid, t.doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * t.n * total.n_docs) // total.n_terms))))::BIGINT AS score
  FROM t JOIN q USING (term) JOIN w USING (term), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
