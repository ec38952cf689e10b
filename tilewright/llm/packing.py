"""Packing of documents into sequences of bounded length by multiway differencing.

1. Each text is encoded; the document is its ids and an end mark. Pieces of the full capacity are cut
   off from its start, each of them a sequence by itself; what is left is one open piece.
2. Open pieces are dealt into groups of about ``WINDOWS`` sequences and at most ``PER_GROUP`` pieces on average by
   a hash of their place, so that no group grows with the table, whatever repeats in it.
3. In a group, Karmarkar-Karp differencing spreads the pieces over k windows: each piece starts as a
   partition of its own, and the two partitions with the largest imbalance are merged so that the
   largest windows of one meet the smallest of the other. k begins at the total over the capacity
   and rises by one while a window exceeds the capacity.

Only counts and checksums leave the encoding, not the ids.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import tokens
from tilewright.llm.common import TABLES, stored, tidy
from tilewright.llm.tokens import installed, tokenizer

FILE, END, CAPACITY, WINDOWS = "word_bpe_49k.json", 2, 4096, 96
#: Bytes of parts and their ids that a worker remembers, the longest part that it does, and bytes of text handled at once.
REMEMBERED, LONGEST, BLOCK = 24 << 20, 32, 4 << 20
#: ASCII marks that are pieces of their own behind a letter.
MARKS = ".,;:!?*%&$#"
#: Pieces of a group.
PER_GROUP = 1 << 15


#: Fixed value: letters of one code point in either case and form.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SMALL = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: For each vocabulary: the tokenizer, its bare model, and which ids end a piece; parts and their ids.
_models: dict[str, tuple] = {}
_known: dict[str, tuple[pa.Array, pa.Array]] = {}
TABLES.extend([_models, _known])


def _own() -> tuple[dict, ...]:
    return _models, _known, tokens._known


def _lists(lists: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.uint32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different parts of the words, and the places there of each word's two; the second may be empty.

    A word that ends with marks behind a letter is two parts, and words in ASCII are lower-cased.
    """
    low = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
    stem = pc.ascii_rtrim(low, characters=MARKS)
    marked = np.flatnonzero(pc.less(pc.binary_length(stem), pc.binary_length(low)))
    marked = marked[pc.match_substring_regex(stem.take(pa.array(marked)), f"[{_LETTERS}]$").to_numpy(zero_copy_only=False)]
    cut = np.zeros(len(words), bool)
    cut[marked] = True
    marks = pc.replace_substring_regex(low.take(pa.array(marked)), f"(?s)^.*[{_LETTERS}]", "")
    parts = pa.concat_arrays([pa.array([""]), pc.if_else(pa.array(cut), stem, low), marks]).dictionary_encode()
    at = parts.indices.to_numpy()
    two = np.zeros((len(words), 2), at.dtype)
    two[:, 0] = at[1 : len(words) + 1]
    two[marked, 1] = at[len(words) + 1 :]
    return parts.dictionary, two


class Encoder:
    """Ids of texts.

    No piece of the tokenizer reaches over white space, so texts are cut there, at ASCII's. Each different part
    of a block is encoded once, and those of earlier blocks are remembered. Small letters up to U+00FF are a piece
    as they are: the tokenizer's model takes their bytes without its normalizer, and the last id of each tells that it ends a word.
    """

    def __init__(self, path: str):
        self.path = path
        if path not in _models:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            whole = tokenizer(path)
            bare = Tokenizer(whole.model)
            bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            last = np.zeros(whole.get_vocab_size(), bool)
            last[[i for w, i in whole.get_vocab().items() if w.endswith("</w>")]] = True
            _models[path] = whole, bare, last
        self.tokenizer, self.bare, self.last = _models[path]

    def _letters(self, parts: list[str]) -> pa.Array:
        """Ids of parts of small letters up to U+00FF."""
        lots, ends, n = [], [], 0
        for at in range(0, len(parts), 1024):
            lot = parts[at : at + 1024]
            ids = np.array(self.bare.encode_batch_fast([" ".join(lot)], add_special_tokens=False)[0].ids, np.uint32)
            end = np.flatnonzero(self.last[ids]) + 1
            if len(end) != len(lot):
                raise ValueError("the vocabulary has no mark for the end of a word")
            lots.append(ids)
            ends.append(end + n)
            n += len(ids)
        return _lists(lots, np.concatenate(ends) if ends else np.zeros(0, np.int64))

    def _others(self, parts: list[str]) -> pa.Array:
        """Ids of any parts: some are encoded as one text, and their offsets deal the ids out."""
        lots, ends, n = [], [], 0
        for at in range(0, len(parts), 4096):
            lot = parts[at : at + 4096]
            e = self.tokenizer.encode(" ".join(lot), add_special_tokens=False)
            starts = np.cumsum([len(w) + 1 for w in lot])
            place = np.array([a for a, _ in e.offsets], np.int64)
            lots.append(np.array(e.ids, np.uint32))
            ends.append(np.searchsorted(place, starts) + n)
            n += len(e.ids)
        return _lists(lots, np.concatenate(ends) if ends else np.zeros(0, np.int64))

    def _of(self, parts: pa.Array) -> pa.Array:
        """The ids of different parts."""
        known, ids = _known.get(self.path) or (pa.array([], pa.string()), _lists([], np.zeros(0, np.int64)))
        at = pc.index_in(parts, value_set=known)
        new = np.flatnonzero(at.is_null())
        letters = pc.match_substring_regex(parts.take(pa.array(new)), _SMALL).to_numpy(zero_copy_only=False)
        place, n = at.fill_null(0).to_numpy().copy(), len(known)
        for mine, encode in ((new[letters], self._letters), (new[~letters], self._others)):
            some = parts.take(pa.array(mine))
            place[mine] = np.arange(n, n + len(mine))
            known, ids, n = pa.concat_arrays([known, some]), pa.concat_arrays([ids, encode(some.to_pylist())]), n + len(mine)
        out = ids.take(pa.array(place))
        if known.nbytes + ids.nbytes > REMEMBERED:  # starts anew, with this block
            known, ids = parts, out
        short = pc.less_equal(pc.binary_length(known), LONGEST)
        _known[self.path] = (known, ids) if pc.all(short).as_py() else (known.filter(short), ids.filter(short))
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each begin, and the end."""
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        of = words.flatten().dictionary_encode()
        parts, two = _parts(of.dictionary)
        pairs = self._of(parts).take(pa.array(two.ravel()))
        each = pa.ListArray.from_arrays(pa.array(pairs.offsets.to_numpy()[::2]), pairs.values).take(of.indices)
        return each.values.to_numpy(), each.offsets.to_numpy()[words.offsets.to_numpy()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        ids, at = self.ids(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def difference(sizes: list[int], k: int) -> list[int]:
    """The window of each item, from k windows with near-equal sums."""
    # a partition: its windows in descending order of their sums, empty ones left out, and the items of each
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)] if k > 1 else []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, j, b, y = heapq.heappop(heap)
        alone = max(0, k - len(b))  # so many of a's places meet an empty one
        free = max(0, k - len(a))
        sums = a[:alone] + b[:free] + [s + b[k - 1 - p] for p, s in enumerate(a[alone:], alone)]
        items = x[:alone] + y[:free] + [s + y[k - 1 - p] for p, s in enumerate(x[alone:], alone)]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums = [sums[o] for o in order]
        least = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (least - sums[0], min(i, j), sums, [items[o] for o in order]))
    window = [0] * len(sizes)
    for w, items in enumerate(heap[0][3] if heap else []):
        for i in items:
            window[i] = w
    return window


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The window of each item; no window holds more than ``capacity``, nor does an item."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = difference(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``, full pieces first.

    ``path`` is another place of the same vocabulary: where texts may be cut follows from its rules.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, mark = Encoder(path or installed(FILE)), np.array([end], "<u4").tobytes()
        for b in batches:
            per = max(1, int(b.num_rows * BLOCK / max(b.column(1).nbytes, 1)))
            for at in range(0, b.num_rows, per):
                part, out = b.slice(at, per), []
                ids, bounds = encoder.ids(part.column(1))
                raw, bounds = memoryview(ids.astype("<u4", copy=False)), bounds.tolist()
                for i, begin, stop in zip(part.column(0).to_pylist(), bounds, bounds[1:]):
                    n = stop - begin + 1  # the end mark behind them
                    for a in range(0, n, capacity):
                        check = zlib.crc32(raw[begin + a : min(begin + a + capacity, stop)])
                        out.append((i, a, min(capacity, n - a), check if n - a > capacity else zlib.crc32(mark, check), n))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(tidy(cut, _own), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """One row for each piece: the columns of ``pieces``, ``sequence_id`` and ``offset``.

    A null or empty text is its end mark alone. Rows whose ids repeat or are null are packed like any
    other. Sequence ids are unique but not dense. An empty table gives no rows.
    """
    cut = stored(pieces(docs, id_col, text, path, end, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(whole[0] or 0) // (windows * capacity)), -(-whole[1] // PER_GROUP))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")  # equal rows spread, too

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        full = int((sizes == capacity).sum())
        window = np.concatenate([np.arange(full), np.array(pack(sizes[full:].tolist(), capacity), np.int64) + full]) if full < len(sizes) else np.arange(full)
        group["sequence_id"] = group["part"].to_numpy() * (1 << 32) + window
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="part")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInPandas(fill, schema)
