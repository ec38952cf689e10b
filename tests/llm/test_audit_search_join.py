"""The filter audit, the lexical search and the n-gram join against brute-force versions, and on awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import filteraudit, lexical, prefixtree

LABELS = "doc_id bigint, quality int, toxic int, source string"


def text_of(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, "12 345 !!"), (5, "a"), (6, "a"), (6, "a"), (None, "no id here at all, but some words"), (None, None),
    (8, "日本語 のテキスト é́ \x00 end\x1c\x85 x\xa0y"), (9, "the same line " * 12), (10, "the same line " * 12), (10, "another Line # of"), (11, "x" * 120_000), (12, text_of(1, 6000)),
    (13, "A B C"), (14, "a b c"), (15, "a b"), (16, "A\tB"),
]


# --- audit ---------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """``rows`` are (doc_id, text, source)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first: dict = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    fails = []
    for i, t, s in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        f += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        fails.append((s, set(f), i in good, i in toxic))
    out, shapley = {}, Counter()
    for s in {r[2] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in fails if r[0] == s]
            mine = list(left)
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[s, c] += len(gone)
                failing = sum(c in r[1] for r in mine)
                out[s, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {c} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(s, o, k): (*v, shapley[s, o[k - 1]]) for (s, o, k), v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(make, spark):
    rng = random.Random(2)
    texts = [text_of(k, rng.choice([5, 49, 50, 60]), rng.choice([20, 500])) for k in range(20)] + [text_of(3, 60).upper(), "Ab# " * 60]
    rows = [(i, rng.choice(texts) + rng.choice(["", "", " #", " X"]), rng.choice(["a", "b", None, ""])) for i in range(100, 260)]
    rows += [(i, t, "b") for i, t in AWKWARD] + [(500 + i, texts[0], "hot") for i in range(80)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(90, 300)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    docs = make([(i, t) for i, t, _ in rows]).drop("source")
    by_row = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs = by_row.select("*", F.lit(1).alias("mask"), F.lit(1).alias("n"), F.lit("x").alias("part"), F.lit("x").alias("quality"), F.lit(2).alias("first"))
    got = filteraudit.audit(docs.repartition(7), spark.createDataFrame([(*r, "clash") for r in labels], LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == brute_audit(rows, labels) and len(got) == 600 * 4


def test_audit_of_empty_tables(make, spark):
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(make([(1, "a")]).where("false"), labels).count() == 0
    got = filteraudit.audit(make([(1, "a")]), labels)
    assert got.count() == 600 and got.agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first() == (0, 0, 120)


def test_fields_are_wide_enough():
    packed, n = filteraudit.packed_outcomes(3), (1 << 62) - 1
    removed, rows = filteraudit.unpacked(n * packed[0b111] + n * packed[0b001], 3)
    assert rows == 2 * n and removed[:, 0].tolist() == [2 * n, 2 * n, n, n, n, n]
    assert removed.sum(axis=1).tolist() == [2 * n] * 6


# --- search --------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for item, ts in asked.items():
        scored = []
        for i, c, n in counts:
            m, score = 50 + 50 * n * n_docs // total, 0
            for t in ts & c.keys():
                df = sum(t in x for _, x, _ in counts)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score:
                scored.append((-score, i is None, i or 0, i))
        out.update({(item, r): (x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)})
    return out


@pytest.mark.parametrize(("lot", "columns", "tile"), [(1 << 18, 2048, 512), (40, 3, 7)])
def test_search_against_brute_force(make, spark, monkeypatch, lot, columns, tile):
    monkeypatch.setattr(lexical, "COLUMNS", columns)
    monkeypatch.setattr(lexical, "DOCS", tile)
    monkeypatch.setattr(lexical, "BYTES", 1000)
    rng = random.Random(5)
    rows = list(AWKWARD) + [(100 + i, text_of(rng.randint(0, 40), rng.randint(1, 80), 60)) for i in range(150)] + [(i, "w1 w2") for i in range(400, 440)]
    items = [(i, text_of(900 + i, 9, 60)) for i in range(12)] + [(20, None), (21, ""), (22, "!?"), (23, "W1 w1 W2"), (23, "the line"), (None, "same é́"), (24, "日本語"), (25, "no such term")]
    docs = make(rows).withColumn("item_id", F.lit("clash")).withColumn("term", F.lit("clash")).withColumn("rank", F.lit(1))
    got = lexical.search(docs.repartition(6), spark.createDataFrame(items, "item_id bigint, text string"), 15, lot).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == brute_search(rows, items, 15)
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)


def test_search_without_documents_or_items(make, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(make([(1, "a")]).where("false"), items).count() == 0
    assert lexical.search(make([(1, "a")]), items.where("false")).count() == 0


def test_wide_items_are_summed_exactly():
    terms = np.arange(3000)
    s = lexical.Scorer(1, np.zeros(3000, np.int64), terms, np.full(3000, 2**30 + 1, np.int64), 10, 10)
    assert s.columns == 8
    times = np.ones(3000, np.int64)
    want = 3000 * (2**30 + 1) * (10**9 // (1000 + 20 * 100))
    assert s.tile(np.array([1]), np.zeros(3000, np.int64), terms, times)[0, 0] == want


# --- join ----------------------------------------------------------------------------------------


def brute_join(rows, words=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family_rows(seed: int, n: int):
    rng = random.Random(seed)
    base = [text_of(50 + k, 90).split() for k in range(5)]
    shared = text_of(7, 40)
    rows = []
    for i in range(20, 20 + n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(40)}"
        t = " ".join(words)
        rows.append((i, t.upper() if i % 5 == 0 else t.replace(" ", "\t") if i % 3 == 0 else t))
    rows += [(1000 + i, f"{shared} {text_of(2000 + i, rng.randint(2, 30))}") for i in range(60)] + [(2000 + i, shared) for i in range(30)]
    return rows + [(3000 + i, " ".join(["p q r s t u v w x y z".split()[k] for k in range(rng.randint(1, 11))])) for i in range(30)]


@pytest.mark.parametrize("settings", [{}, {"members": 4, "leads": 1}, {"members": 9, "shingles": 300, "leads": 2}])
def test_join_against_brute_force(make, settings):
    rows = [r for r in AWKWARD if r[0] is not None and r[0] not in (6, 10)] + family_rows(9, 140)
    docs = make(rows).withColumn("head", F.lit("clash")).withColumn("home", F.lit("clash")).withColumn("prefix", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefixtree.join(docs.repartition(5), **settings).collect()}
    assert got == brute_join(rows)


def test_trees_find_every_link_once():
    rng = random.Random(3)
    for percent in (50, 80, 90, 100):
        base = [rng.sample(range(300), 40) for _ in range(4)]
        sets = []
        for _ in range(60):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 8)):
                s ^= {rng.randrange(300)}
            sets.append(frozenset(s))
        sets = [np.array(sorted(s), np.uint64) for s in set(sets) if s] + [np.array([1 << 63], np.uint64)]
        want = set()
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    want.add((j, i))
        got = [tuple(sorted(p)) for p in prefixtree.Tree(sets, percent).links()]
        assert len(got) == len(set(got)) and set(got) == want
        joining = prefixtree.Tree(sets, percent).links(list(range(len(sets))))
        assert {tuple(sorted(p)) for p in joining} <= want


def test_repeated_and_missing_ids_in_a_join(make):
    t, u = text_of(3, 50), text_of(4, 60)
    docs = make([(20, t + " one"), (20, u + " one"), (21, u + " two"), (22, t + " two")])
    assert {r.component_id for r in prefixtree.join(docs).collect()} == {20}
    docs = make([(5, t), (4, t.upper()), (4, t), (7, ""), (8, None), (None, t), (9, "other words"), (9, t)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in prefixtree.join(docs).collect())
    assert got == [(0, 48, None), (4, 48, 4), (4, 48, 4), (5, 48, 4), (7, 0, 7), (8, 0, 8), (9, 1, 9), (9, 48, 4)]
    assert prefixtree.join(docs.where("false")).count() == 0


def test_prefix_lengths_and_overlaps():
    for percent in (50, 85, 90, 100):
        for n in range(1, 60):
            partners = [m for m in range(1, 140) if prefixtree.least_overlap(n, m, percent) <= min(n, m)]
            need = min(prefixtree.least_overlap(n, m, percent) for m in partners)
            assert prefixtree.prefix_length(n, percent) >= n - need + 1
