"""Interaction of quality filters over all orders, with wide packed counters.

A document fails a set of filters, its mask. Under one order of the filters it is removed at the step
of the first filter that it fails, so a mask decides the outcome of every step of every order. Each
mask is mapped to one big integer with a field for each (order, step), 1 where the document is
removed, and a last field that counts the document: 5 filters make 120 * 5 + 1 fields. The integers of
a part are summed; fields are 64 bits wide and a table has fewer than 2^63 rows, so that no field
runs into the next one. Equal masks of a part are counted before the shuffle, and their integer is
added that many times by one product. All reported counts are read from the fields:

- a filter that comes first removes all that fail it, one that comes last all that fail it alone;
- what it fails and did not remove was removed before it.

Which documents repeat an earlier text is decided without moving texts and without one task per text:
rows are held against the smallest id of their digest on (digest, id), which spreads the copies.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import stored

BITS = 64


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def few_words(text: Column) -> Column:
    return F.size(_words(text)) < 50


def repeated_words(text: Column) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def many_capitals(text: Column) -> Column:
    rest = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return 100 * (F.length(text) - F.length(rest)) > 5 * F.length(text)


def has_symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: What a text fails, by letter. None stands for the copy filter: the text of a smaller id is the same.
FILTERS: dict[str, Callable[[Column], Column] | None] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": has_symbols, "E": None}


def packed_outcomes(n: int, bits: int = BITS) -> list[int]:
    """The integer of each mask over ``n`` filters; field ``order * n + step`` tells removal, the last one is 1."""
    orders = list(permutations(range(n)))
    out = []
    for mask in range(1 << n):
        packed = 1 << (bits * n * len(orders))
        for o, order in enumerate(orders):
            step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                packed |= 1 << (bits * (o * n + step))
        out.append(packed)
    return out


def unpacked(total: int, n: int, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Removals by (order, step), and the number of documents, of a sum of such integers."""
    fields = factorial(n) * n
    raw = total.to_bytes((fields + 1) * bits // 8, "little")
    counts = np.frombuffer(raw, f"<u{bits // 8}").astype(np.int64)
    return counts[:fields].reshape(-1, n), int(counts[fields])


def masks(docs: DataFrame, filters: dict[str, Callable[[Column], Column] | None] = FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """``(doc_id, part, mask, n)``: how many rows of an id and part fail exactly the filters of ``mask``.

    A null text is empty, a null part the empty string. A row whose id is null is neither a copy nor
    an original. Rows that share an id are not copies of each other.
    """
    whole, zero = F.coalesce(F.col(text), F.lit("")), F.lit(0)
    bits = [F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values()) if fails]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("text"))
    seen = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, zero).cast("int").alias("mask"))
    seen = seen.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    copy = next((1 << i for i, fails in enumerate(filters.values()) if fails is None), 0)
    if not copy:
        return seen.drop("digest")
    seen = stored(seen, "masks")
    firsts = seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    is_copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return seen.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(is_copy, copy).otherwise(0)).alias("mask"), "n")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column] | None] = FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``kept`` remain after the step, ``removed`` go at it, ``redundant`` fail its filter but went
    before, ``unique_fails`` fail its filter only, ``good_lost`` and ``toxic_lost`` are removed rows
    whose label is 1, ``shapley`` sums the filter's removals over all orders. Labels that repeat an
    id count as one that has all their marks; labels without an id belong to no row. An empty table
    of documents has no parts. Other columns, whatever their names, are left aside.
    """
    letters = list(filters)
    n, packed = len(letters), packed_outcomes(len(letters))
    orders = list(permutations(range(n)))
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    known = masks(docs, filters, text, part).join(marks, "doc_id", "left")
    no = F.lit(False)
    counted = known.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))
    filter_of = np.array(orders)
    names = np.repeat(["".join(letters[f] for f in o) for o in orders], n)
    steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))

    def report(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """At most four rows for each mask."""
        sums = [0, 0, 0]
        for mask, good, toxic, times in zip(group["mask"].tolist(), group["good"].tolist(), group["toxic"].tolist(), group["n"].tolist()):
            value = times * packed[mask]
            for i, counts in enumerate((True, good, toxic)):
                if counts:
                    sums[i] += value
        (removed, rows), (good_lost, _), (toxic_lost, _) = (unpacked(s, n) for s in sums)
        first = {int(o[0]): removed[i, 0] for i, o in enumerate(filter_of)}
        last = {int(o[-1]): removed[i, -1] for i, o in enumerate(filter_of)}
        shapley = np.array([removed[filter_of == f].sum() for f in range(n)])
        fails, alone = (np.array([d[f] for f in range(n)])[filter_of] for d in (first, last))
        columns = {
            "kept": rows - removed.cumsum(axis=1), "removed": removed, "redundant": fails - removed, "unique_fails": alone,
            "good_lost": good_lost, "toxic_lost": toxic_lost, "shapley": shapley[filter_of],
        }
        return pd.DataFrame({"part": key[0], "filter_order": names, "step": steps} | {c: v.reshape(-1) for c, v in columns.items()})

    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counted.groupBy("part").applyInPandas(report, f"part string, filter_order string, step int, {counts}")


ORACLE = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (
  SELECT part, doc_id,
    (len(words) < 50)::BIGINT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::BIGINT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::BIGINT
    + 8 * regexp_matches(t, '[#$%&*|]')::BIGINT + 16 * coalesce(doc_id > first_id, FALSE)::BIGINT AS mask
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v (letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
  FROM o, range(1, 6) r (step)),
c AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
