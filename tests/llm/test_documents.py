"""Each operator on documents against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import components, decontaminate, language, neardup, packing, shards, suffix, tokens



def long_text(seed: int, n: int, vocabulary: int = 4000) -> str:
    """Made-up words, the same for a seed."""
    rng = np.random.default_rng(seed)
    return " ".join("w" + "abcdefghij"[i % 10] + str(i) for i in rng.integers(0, vocabulary, n))


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "12 345 !!"), (5, "a"), (6, "a"), (None, "no id here at all, but some words"), (8, "日本語 のテキスト é́ \x00 end"),
    (9, "the same line " * 12), (10, "the same line " * 12), (10, "the same line " * 12), (11, "x" * 120_000), (12, long_text(1, 6000)),
]


@pytest.fixture(scope="module")
def awkward(make):
    return make(AWKWARD)


@pytest.fixture(scope="module")
def empty(make, awkward):
    return awkward.where("false")


def test_the_awkward_table_passes_every_operator(awkward, empty):
    bench = awkward.select(F.col("doc_id").alias("item_id"), "text")
    for run in (
        language.identify_documents, language.keep_identified, neardup.classes, neardup.keep_one_of_each, suffix.digest, suffix.remove_repeats,
        packing.sequences, shards.assign, tokens.document_tokens,
    ):
        assert run(empty).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(awkward, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(awkward, bench.where("false")).count() == len(AWKWARD)
    for run in (language.identify_documents, neardup.classes, suffix.digest, suffix.remove_repeats, shards.assign, tokens.document_tokens):
        assert run(awkward).count() == len(AWKWARD)
    assert packing.sequences(awkward).where("start = 0").count() == len(AWKWARD)
    assert {r.doc_id for r in language.keep_identified(awkward).collect()} <= {None, *range(5, 13)}
    assert sorted(r.doc_id or 0 for r in neardup.keep_one_of_each(awkward).collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 11, 12]


# --- language ------------------------------------------------------------------------------------

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "uvwxyzéü"}


def spoken(lang: str, rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_are_learned_and_others_are_unknown(make):
    rng = random.Random(1)
    rows = [(i, spoken(lang, rng, rng.randint(3, 60)), lang) for i, lang in enumerate(list(LETTERS) * 40)]
    rows += [(900, "123 !?", "aa"), (901, None, "aa"), (902, "", None), (903, spoken("bb", rng, 5), None)]
    got = {r.doc_id: r for r in language.identify_documents(make(rows)).collect()}
    assert len(got) == len(rows) and {r.lang_pred for r in got.values()} == {"aa", "bb", "cc", "und"}
    for i, _, lang in rows[:120]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 < got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb"
    kept = language.keep_identified(make(rows))
    assert kept.columns == make(rows).columns and kept.count() == len(rows) - 3


def test_bundles_are_sums_of_bound_letters():
    maker = language.Profiler(256, 3)
    got = maker.bundles(["Abc!! d", None])
    v = {c: language.letter_vectors(np.array([ord(c)]), 256, 3)[0].astype(int) for c in "abcd "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in ("abc", "bc ", "c d", " d "))
    assert np.array_equal(got[0], want) and not got[1].any()


def test_the_memory_of_bundles_does_not_grow_with_rows_times_trigrams():
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 397, 300))) for _ in range(3000)]  # nearly all trigrams differ
    maker = language.Profiler()
    maker.bundles(texts[:1])
    tracemalloc.start()
    out = maker.bundles(texts)
    peak = tracemalloc.get_traced_memory()[1] - out.nbytes
    tracemalloc.stop()
    assert peak < 150e6


def test_blocks_rows_and_trigrams_at_a_time_do_not_change_bundles(monkeypatch):
    texts = [long_text(i, 30 * i) + " éü日本" * i for i in range(9)] + [None, "", "ab", "abc"]
    classes = np.arange(len(texts)) % 3
    want, summed = language.Profiler(64).bundles(texts), language.Profiler(64).sums(texts, classes, 3)
    for name, value in (("BLOCK", 500), ("ROWS", 2), ("GRAMS", 7)):
        monkeypatch.setattr(language, name, value)
        assert np.array_equal(language.Profiler(64).bundles(texts), want)
        assert np.array_equal(language.Profiler(64).sums(texts, classes, 3), summed)


def test_one_language_or_none(make):
    one = language.identify_documents(make([(1, "abc def", "aa"), (2, "abc", "aa"), (3, "abc", None)])).collect()
    assert {r.lang_pred for r in one} == {"aa"}
    none = language.identify_documents(make([(1, "abc def", None)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


# --- repeated passages ---------------------------------------------------------------------------


def brute_removed(rows, length):
    """(bytes, removed, runs, digest) by id; equal ids do not cover each other."""
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if i is not None and first[raw[s : s + length]] < i:
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.setdefault(i, []).append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batch", [7, 1 << 17])
def test_suffix_dedup_against_brute_force(make, batch):
    rng = random.Random(4)
    passages = [long_text(100 + k, 14) for k in range(6)]
    rows = list(AWKWARD[:11])
    for i in range(20, 70):
        parts = [rng.choice(passages) if rng.random() < 0.5 else long_text(i * 7 + k, rng.randint(1, 25)) for k in range(rng.randint(1, 5))]
        rows.append((i, " é ".join(parts)))
    rows += [(100 + k, rows[15][1]) for k in range(30)] + [(200 + k, passages[0] + " x" * k) for k in range(40)] + [(300, "ab" * 400), (301, "ba" * 300)]
    got = defaultdict(list)
    for r in suffix.digest(make(rows).repartition(5), batch=batch).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == brute_removed(rows, 50)


def test_removed_spans_leave_valid_text(make):
    cut = suffix.remove_repeats(make([(1, "é" * 60), (2, "a" + "é" * 60 + "b"), (3, None)])).orderBy("doc_id").collect()
    assert cut[0].text == "é" * 60 and cut[1].text == "ab" and cut[2].text is None
    assert [(s.start, s.stop) for s in cut[1].removed_spans] == [(1, 121)]


def test_levels_have_distinct_powers_of_two():
    index = suffix.LogarithmicIndex()
    for k in range(1, 14):
        index.add(suffix._level(np.array([b"%04d" % k, b"same"], "S4"), np.array([k, k]), 1))
        assert [x.batches for x in index.levels] == [1 << b for b in range(5, -1, -1) if k >> b & 1]
    assert index.first_documents(np.array([b"0007", b"nope", b"same"], "S4")).tolist()[0::2] == [7, 1]


# --- near duplicates -----------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_against_brute_force(make):
    rng = random.Random(9)
    rows = [r for r in AWKWARD if r[0] is not None and r[0] != 10]
    base = [long_text(50 + k, 120).split() for k in range(5)]
    for i in range(20, 150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        rows.append((i, ("\t" if i % 3 else " ").join(words).upper() if i % 5 == 0 else " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_one_of_each_class_stays(make):
    t = long_text(3, 50)
    docs = make([(5, t), (4, t.upper()), (4, t), (7, ""), (8, None), (None, t), (9, "other words")])
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 7), (False, 8), (False, 9), (True, 0)]


def test_sketches_fill_every_place_and_estimate():
    rng = np.random.default_rng(0)
    assert all((neardup.sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64)) != 0).all() for n in (1, 2, 5, 100, 3000))
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    shares = [(neardup.sketch(np.unique(x[: 1000 - k])) == neardup.sketch(np.unique(x))).mean() for k in (0, 150, 500)]
    assert shares[0] == 1 and abs(shares[1] - 0.85) < 0.12 and abs(shares[2] - 0.5) < 0.16


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 299


# --- decontamination -----------------------------------------------------------------------------


def test_reparameterised_questions_are_caught_and_others_left(make, spark):
    item = "On Monday the train from Oldtown carries 120 crates of 15 kg each, and then Maria unloads 40 crates; how many kg are left on it?"
    other = item.replace("120", "75").replace("15 kg", "8 km").replace("40", "33").replace("Oldtown", "Newport").replace("Maria", "Peter")
    mixed = item + " " + long_text(5, 30)
    clash = "Add 5 apples to the box and then 5 pears to the box and then 5 plums to the box now."
    twisted = "Add 5 apples to the box and then 6 pears to the box and then 7 plums to the box now."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three four five"), (5, "too short"), (6, clash), (None, item)], "item_id int, text string")
    docs = make([
        (1, long_text(6, 20) + " " + other + " " + long_text(7, 20)), (2, mixed.upper()), (3, long_text(8, 200)), (4, None), (5, "zero one two three four five six"),
        (6, " ".join(item.split()[:9])), (7, twisted), (8, clash.replace("5", "9")), (None, item), (9, "too short"),
    ])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 4), (8, 6)}
    assert got[1, 1].share > 0.9 and got[2, 1].n_windows >= 6 and got[1, 1].n_slots >= 5
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 6


def test_changed_words_lose_no_occurrence_at_any_place(make, spark):
    item = spoken("aa", random.Random(21), 22).split()
    rows, want = [], set()
    for at in range(22):
        said = [*item[:at], "changed", *item[at + 1 :]]
        for lead in range(6):
            rows.append((10 * at + lead, " ".join(["so"] * lead + said + ["end"])))
            if max(at - 7, 0) + max(22 - at - 8, 0) >= 6:
                want.add(10 * at + lead)
    got = decontaminate.matches(make(rows), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string"))
    assert 11 * 10 + 1 in want and {r.doc_id for r in got.collect()} == want


def test_questions_that_start_with_other_names_are_dropped(make, spark):
    item = "Maria has 12 apples. Maria buys 7 more apples. Peter takes 5 apples. How many apples are left?"
    short = "Maria has 12 apples and buys 7 more apples at the market"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id int, text string")
    other = item.replace("Maria", "Anna").replace("Peter", "John").replace("12", "31").replace("7", "8")
    docs = make([
        (1, other), (2, "So. " + short.replace("Maria", "Anna")), (3, other.replace("Anna buys", "Clara buys")), (4, item), (5, item.lower()),
        (6, "Anna has 31 pears. Anna buys 8 more plums. John takes 5 figs. How many are left?"),
    ])
    got = {r.doc_id: r.n_windows for r in decontaminate.matches(docs, bench, starts=True).collect()}
    assert got == {1: 11, 2: 5, 4: 11, 5: 11}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 6}


# --- shards --------------------------------------------------------------------------------------


def test_shards_have_the_smallest_capacity(make, monkeypatch):
    monkeypatch.setattr(shards, "BITS", 3)
    monkeypatch.setattr(shards, "ATOMS", 16)
    rng = random.Random(3)
    rows = [(i, "t" * rng.randint(0, 60) + str(rng.randint(0, 80))) for i in range(10, 310)] + AWKWARD[:4]
    got = shards.assign(make(rows), 7).collect()
    assert len(got) == len(rows)
    of, sizes = {}, defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(7))
    text = dict((i, t or "") for i, t in rows)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert of.setdefault(raw, r.shard) == r.shard
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(sizes.values()) <= 1.25 * sum(sizes.values()) / 7


def test_a_large_group_gets_a_shard_of_its_own(make):
    rows = [(i, "hot text of a third of all rows") for i in range(150)] + [(1000 + i, f"row {i}") for i in range(150)]
    got = shards.assign(make(rows), 5).groupBy("shard").agg(F.sum("size").alias("b"), F.count_distinct("text_crc32").alias("n")).collect()
    hot = [r for r in got if r.n == 1]
    rest = [r.b for r in got if r.n > 1]
    assert len(hot) == 1 and len(rest) == 4 and max(rest) - min(rest) < 100


def test_smallest_capacity_against_all_partitions():
    rng = random.Random(5)
    for _ in range(300):
        w, k = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))], rng.randint(1, 5)

        def best(at, left):
            if left == 1:
                return sum(w[at:])
            return min(max(sum(w[at:to]), best(to, left - 1)) for to in range(at, len(w) + 1))

        assert shards.smallest_capacity(w, k)[0] == best(0, k)


# --- tokens and packing --------------------------------------------------------------------------


def awkward_texts(n: int, parts: int):
    rng = random.Random(n)
    bits = ["a", "the", " ", " ", "\n", "\t", "  ", "'s", "12", "é", "<|endoftext|>", "!!", "\x1c", "́", "日本", "\x85", ".", "Σ", "İ", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, parts))) for _ in range(n)]


def test_counts_are_the_tokenizers(make):
    whole = tokens.tokenizer(tokens.installed(tokens.FILE))
    texts = [None, "", *awkward_texts(300, 30), long_text(2, 20_000)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.document_tokens(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_splices_are_exact_and_overlaps_widen():
    whole = tokens.tokenizer(tokens.installed(tokens.FILE))

    def encode(s):
        e = whole.encode(s, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    for t in [*awkward_texts(400, 300), "a" * 2000, " " * 500 + "b", "ab " * 400]:
        assert tokens.spliced(t, encode, 40, 8) == whole.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(make):
    whole = tokens.tokenizer(tokens.installed(packing.FILE))
    texts = [None, "", *awkward_texts(60, 40), *[long_text(k, 30 * k) for k in range(60)], long_text(2, 6000)]
    got = packing.sequences(make(list(enumerate(texts))), windows=8).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in got) > 0.9 * 4096 * len(by_seq)


def test_ids_of_every_letter_are_the_tokenizers():
    whole, encoder = tokens.tokenizer(tokens.installed(packing.FILE)), packing.Encoder(tokens.installed(packing.FILE))
    rng = random.Random(8)
    chars = [chr(c) for c in [*range(1, 0x0600), *range(0x1E00, 0x2100), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [c for c in chars] + [f"a{c}b {c}mi{c}" for c in chars] + ["Ətraf mühit", "Ɛdeen", "Ɗan Ɓera"]
    texts += ["".join(rng.choice(chars) if rng.random() < 0.2 else rng.choice("aB '1.") for _ in range(30)) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        lot = texts[at : at + 500]
        for t, ids in zip(lot, encoder.encode(lot)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_many_empty_texts_and_one_hot_row_are_packed(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("id") % 3 == 0, "").alias("text"))
    got = packing.sequences(rows)
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    r = sums.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("k"), F.max(F.abs(F.col("n") - F.col("end"))).alias("gap")).first()
    assert (r.n, r.gap) == (400_000, 0) and r.most <= 4096 and r.k < 120


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 300).tolist()
    sums = np.bincount(packing.difference(sizes, 16), weights=sizes)
    assert len(sums) == 16 and sums.max() - sums.min() <= 8
    assert packing.pack([4096, 4096, 1], 4096) is not None and max(packing.pack([3000] * 5, 4096)) == 4
