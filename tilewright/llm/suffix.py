"""Removal of long passages that an earlier document holds, by a logarithmic family of suffix arrays.

A passage is a string of ``length`` bytes (50) that also starts in a document with a smaller id.

1. Rows are packed into chunks of a few MB, written once; all later steps read these.
2. Each string of 50 bytes is filed under its anchor, the smallest hash among its 16-byte
   substrings. Equal strings have equal anchors, and consecutive strings mostly share one, so a
   segment (the run of strings under one anchor) is what is sorted and moved, not single suffixes.
3. Anchors that only one document holds cannot match and are left out. A text that is a copy of an
   earlier document's is covered as a whole and goes no further.
4. The others are dealt into buckets by anchor. A chunk sends the first of its equal segments
   only: the rest are covered by it. So a passage in very many documents sends one segment a chunk.
5. In a bucket, strings whose fingerprint recurs in another document are kept, and documents come in
   batches by id. A batch gets a sorted array of its suffixes (their first 50 bytes), is merge-scanned against each level of the family, and becomes a level
   itself; levels of equal size merge, so each suffix is merged at most log2(batches) times.
6. Covered ranges go back to their chunk.

Everything is exact: hashes choose where to look, and bytes decide.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import TABLES, stored, tidy, tidy_group

LENGTH = 50
ANCHOR = 16
#: Bytes of text: of a chunk, of a block of positions hashed at once, of text per bucket.
CHUNK, BLOCK, PER_BUCKET = 1 << 20, 1 << 18, 4 << 20
#: Strings of a batch in a bucket, and of a segment at most.
BATCH, RUN = 1 << 17, 256

_U = np.uint64
_DROPPED = _U(16)
_BASE = 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}
TABLES.append(_powers)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"], _powers["down"]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=_U, out=out[1:])
    return out


@dataclass
class Segments:
    """Runs of strings under one anchor: anchor hash, row of the chunk, first and end string's start."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def _block_segments(pieces: list[tuple[int, int, bytes]], length: int, anchor: int) -> Segments | None:
    """pieces: row, offset in the row, bytes."""
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    if len(data) < length:
        return None
    lens = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(lens)
    c = _prefix(data)
    _, down = _power(len(data) + 1)
    grams = _mixed((c[anchor:] - c[:-anchor]) * down[: len(data) - anchor + 1])
    least = _sliding_min(grams, length - anchor + 1)
    piece = np.repeat(np.arange(len(pieces)), lens)[: len(least)]
    valid = np.arange(len(least)) + length <= ends[piece]
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    least, piece = least[at], piece[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > RUN:  # a long run is cut; its parts stay under the same anchor
        cuts = np.concatenate([np.arange(f, f + n, RUN) for f, n in zip(first[size > RUN], size[size > RUN])])
        first = np.union1d(first, cuts)
        size = np.diff(np.append(first, len(at)))
    rows, offs = np.array([r for r, _, _ in pieces]), np.array([o for _, o, _ in pieces])
    p = piece[first]
    start = at[first] - (ends - lens)[p] + offs[p]
    # smallest hashes are small numbers; mixed again they are even, so buckets are too
    return Segments(_mixed(least[first] ^ _U(0x6A09E667F3BCC909)), rows[p], start, start + size)


def segments(texts: list[bytes | None], length: int = LENGTH, anchor: int = ANCHOR) -> Segments:
    """The segments of all texts (None: none), whole texts in blocks."""
    found, pieces, held = [], [], 0
    for r, t in enumerate(texts):
        for at in range(0, len(t or b"") - length + 1, BLOCK):
            piece = t[at : at + BLOCK + length - 1]
            if held + len(piece) > BLOCK + length and pieces:
                found.append(_block_segments(pieces, length, anchor))
                pieces, held = [], 0
            pieces.append((r, at, piece))
            held += len(piece)
    if pieces:
        found.append(_block_segments(pieces, length, anchor))
    found = [f for f in found if f is not None]
    empty = (np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    parts = zip(*((f.key, f.row, f.start, f.stop) for f in found)) if found else ([x] for x in empty)
    return Segments(*(np.concatenate(list(p)) for p in parts))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed planes of bytes, the low ones first."""
    out = io.BytesIO()
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        out.write(f"{a.dtype.str},{len(a)};".encode())
        out.write(planes.tobytes())
    return zstandard.compress(out.getvalue(), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        end = raw.index(b";", at)
        kind, n = raw[at:end].decode().split(",")
        kind, n, at = np.dtype(kind), int(n), end + 1
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _pack_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _pack(keys[:1], np.diff(keys), *more)


def _unpack_keys(blob: bytes) -> list[np.ndarray]:
    first, steps, *more = _unpack(blob)
    return [np.cumsum(np.concatenate([first, steps]), dtype=_U), *more]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys, so that a sorted array falls into slices."""
    return ((keys >> _U(40)) * _U(n) >> _U(24)).astype(np.int64)


def _by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    b = _bucket(keys, n)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    for i, j in zip(first, [*first[1:], len(b)]):
        yield int(b[i]), slice(i, j)


@dataclass
class Level:
    """Distinct strings in suffix order, the smallest document of each, and how many batches it holds."""

    strings: np.ndarray
    docs: np.ndarray
    batches: int = 1


def _level(strings: np.ndarray, docs: np.ndarray, batches: int) -> Level:
    """Sorts strings; two sorted runs merge in linear time."""
    order = np.argsort(strings, kind="stable")
    strings, docs = strings[order], docs[order]
    first = np.flatnonzero(np.append(True, strings[1:] != strings[:-1]))
    return Level(strings[first], np.minimum.reduceat(docs, first), batches)


@dataclass
class LogarithmicIndex:
    """Levels of suffix arrays whose batch counts are distinct powers of two."""

    levels: list[Level] = field(default_factory=list)

    def first_documents(self, strings: np.ndarray) -> np.ndarray:
        """The smallest indexed document for each of the sorted strings; the largest integer if none."""
        best = np.full(len(strings), np.iinfo(np.int64).max)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.strings, strings), len(level.strings) - 1)
            hit = level.strings[at] == strings
            best[hit] = np.minimum(best[hit], level.docs[at[hit]])
        return best

    def add(self, batch: Level) -> None:
        while self.levels and self.levels[-1].batches <= batch.batches:
            last = self.levels.pop()
            batch = _level(
                np.concatenate([last.strings, batch.strings]), np.concatenate([last.docs, batch.docs]), last.batches + batch.batches
            )
        self.levels.append(batch)


def _recurring(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of the strings whose fingerprint also occurs in another document.

    Other strings match nothing, so they need no place in a suffix array.
    """
    prints, segment, offset = [], [], []
    lot, size, first = [], 0, 0
    for n, c in enumerate(contents):
        lot.append(c)
        size += len(c)
        if size < BLOCK and n + 1 < len(contents):
            continue
        data = np.frombuffer(b"".join(lot), np.uint8)
        lens = np.array([len(x) for x in lot])
        sizes = lens - length + 1
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begin = np.repeat(np.cumsum(lens) - lens, sizes) + within
        sums = _prefix(data)
        prints.append(_mixed((sums[begin + length] - sums[begin]) * _power(len(data) + 1)[1][begin]))
        segment.append(np.repeat(np.arange(first, first + len(lot)), sizes))
        offset.append(within)
        lot, size, first = [], 0, n + 1
    key, segment, offset = np.concatenate(prints), np.concatenate(segment), np.concatenate(offset)
    order = np.argsort(key)
    key, doc = key[order], docs[segment[order]]
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
    keep = np.sort(order[np.repeat(several, np.diff(np.append(group, len(key))))])
    return segment[keep], offset[keep]


def scan_bucket(contents: list[bytes], docs: np.ndarray, length: int = LENGTH, batch: int = BATCH) -> list[np.ndarray]:
    """For each segment: which of its strings start in a segment of a document with a smaller id.

    Segments are distinct in content; equal ones of other documents are the caller's.
    """
    out = [np.zeros(len(c) - length + 1, bool) for c in contents]
    segment, offset = _recurring(contents, docs, length)
    order = np.argsort(docs[segment], kind="stable")
    segment, offset = segment[order], offset[order]
    owner = docs[segment]
    index, at = LogarithmicIndex(), 0
    while at < len(owner):
        to = min(at + batch, len(owner))
        to = int(np.searchsorted(owner, owner[to - 1], "right"))  # a document stays in one batch
        strings = np.array([contents[s][o : o + length] for s, o in zip(segment[at:to].tolist(), offset[at:to].tolist())], f"S{length}")
        level = _level(strings, owner[at:to], 1)
        earliest = np.minimum(level.docs, index.first_documents(level.strings))
        hit = np.flatnonzero(earliest[np.searchsorted(level.strings, strings)] < owner[at:to]) + at
        for s, o in zip(segment[hit].tolist(), offset[hit].tolist()):
            out[s][o] = True
        index.add(level)
        at = to
    return out


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def _texts(batch: pa.RecordBatch, id_col: str, text: str) -> tuple[list, list[bytes | None]]:
    """Ids and texts as bytes; a row without an id takes no part."""
    ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
    raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
    return ids, [None if i is None else t for i, t in zip(ids, raw)]


def _chunks(docs: DataFrame, text: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0

        def out(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal n
            n += 1
            whole = pa.Table.from_batches(lot).combine_chunks().to_batches()[0]
            size = whole.column(whole.schema.get_field_index(text)).cast(pa.binary()).nbytes
            return pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([size]), pa.array([_ipc(whole)], pa.binary())], names=["chunk", "size", "rows"])

        lot, held = [], 0
        for b in batches:
            per = max(1, int(b.num_rows * CHUNK / max(b.nbytes, 1)))
            for i in range(0, b.num_rows, per):
                part = b.slice(i, per)
                lot.append(part)
                held += part.nbytes
                if held >= CHUNK:
                    yield out(lot)
                    lot, held = [], 0
        if lot:
            yield out(lot)

    return stored(docs.mapInArrow(tidy(pack), "chunk long, size long, rows binary"), "suffix-chunks")


def _shared_anchors(chunks: DataFrame, id_col: str, text: str, length: int, anchor: int, buckets: int) -> DataFrame:
    """For each chunk, the anchors that at least two documents hold.

    Only 48 bits of an anchor travel; a chance agreement costs a comparison and changes nothing.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, texts = _texts(_rows(blob), id_col, text)
                s = segments(texts, length, anchor)
                if not len(s.key):
                    continue
                doc = np.array([0 if i is None else i for i in ids], np.int64)[s.row]
                order = np.lexsort((doc, s.key))
                key, doc = s.key[order] >> _DROPPED, doc[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                several = np.maximum.reduceat(doc, first) != doc[first]
                rows = [(n, chunk, _pack_keys(key[first][sl], several[sl].astype(np.uint8))) for n, sl in _by_bucket(key[first] << _DROPPED, buckets)]
                bucket, own, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(own), pa.array(keys, pa.binary())], names=["bucket", "chunk", "keys"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keys, several = zip(*map(_unpack_keys, group["keys"]))
        several = np.concatenate(several)
        known, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[place[several > 0]] = True
        kept = np.split(shared[place], np.cumsum([len(k) for k in keys])[:-1])
        out = [(c, _pack_keys(k[m])) for c, k, m in zip(group["chunk"], keys, kept) if m.any()]
        return pd.DataFrame(out, columns=["chunk", "keys"])

    anchors = chunks.select("chunk", "rows").mapInArrow(tidy(emit), "bucket long, chunk long, keys binary")
    return anchors.groupBy("bucket").applyInPandas(tidy_group(meet), "chunk long, keys binary").groupBy("chunk").agg(F.collect_list("keys").alias("keys"))


def _copies(chunks: DataFrame, id_col: str, text: str, length: int) -> DataFrame:
    """For each chunk, the rows whose whole text a document with a smaller id has."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, texts = _texts(_rows(blob), id_col, text)
                alike: dict[bytes, list[int]] = {}
                for i, t in enumerate(texts):
                    if t is not None and len(t) >= length:
                        alike.setdefault(hashlib.blake2b(t, digest_size=16).digest(), []).append(i)
                doc = [min(ids[i] for i in rows) for rows in alike.values()]
                first = [[i for i in rows if ids[i] == d] for rows, d in zip(alike.values(), doc)]
                later = [[i for i in rows if ids[i] != d] for rows, d in zip(alike.values(), doc)]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = ([chunk] * len(doc), doc, list(alike), first, later)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "doc", "mark", "first", "later"])

    # one row for each text and chunk, so that a text of very many copies stays a few rows
    marks = stored(chunks.select("chunk", "rows").mapInArrow(tidy(mark), "chunk long, doc long, mark binary, first array<long>, later array<long>"), "marks")
    least = marks.groupBy("mark").agg(F.min("doc").alias("least"))
    copies = F.when(F.col("doc") > F.col("least"), F.concat("first", "later")).otherwise(F.col("later"))
    found = marks.join(least, "mark").select("chunk", copies.alias("copies")).where(F.size("copies") > 0)
    return found.groupBy("chunk").agg(F.flatten(F.collect_list("copies")).alias("copies"))


def _spans(chunks: DataFrame, shared: DataFrame, id_col: str, text: str, length: int, anchor: int, buckets: int, batch: int) -> DataFrame:
    """Covered byte ranges of each chunk's rows, as packed arrays."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, lists, copies in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids, texts = _texts(_rows(blob), id_col, text)
                whole = np.array(copies or [], np.int64)
                ends = np.array([len(texts[i]) for i in whole.tolist()], np.int64)
                for i in whole.tolist():
                    texts[i] = None
                keys = np.sort(np.concatenate([_unpack_keys(k)[0] for k in lists or []] or [np.zeros(0, _U)]))
                s = segments(texts, length, anchor)
                keep = np.flatnonzero(np.isin(s.key >> _DROPPED, keys, kind="sort"))
                doc = np.array([0 if i is None else i for i in ids], np.int64)[s.row[keep]]
                keep = keep[np.lexsort((doc, s.key[keep]))]
                doc = np.array([0 if i is None else i for i in ids], np.int64)[s.row[keep]]
                content = [texts[r][i : j + length - 1] for r, i, j in zip(s.row[keep].tolist(), s.start[keep].tolist(), s.stop[keep].tolist())]
                first: dict[bytes, int] = {}
                here = np.array([first.setdefault(c, d) == d for c, d in zip(content, doc.tolist())], bool)
                done = keep[~here]  # an earlier document of this chunk has all of the segment
                covered = _pack(
                    np.concatenate([s.row[done], whole]).astype(np.int32),
                    np.concatenate([s.start[done], np.zeros(len(whole), np.int64)]),
                    np.concatenate([s.stop[done] + length - 1, ends]),
                )
                out = [(chunk % buckets, chunk, True, covered)] if len(done) or len(whole) else []
                sent, doc, content = keep[here], doc[here], [c for c, h in zip(content, here) if h]
                for n, sl in _by_bucket(s.key[sent], buckets):
                    sizes = np.array([len(c) for c in content[sl]], np.int32)
                    data = np.frombuffer(b"".join(content[sl]), np.uint8)
                    out.append((n, chunk, False, _pack(doc[sl], s.row[sent][sl].astype(np.int32), s.start[sent][sl], sizes, data)))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.binary())], names=["bucket", "chunk", "done", "blob"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        out = list(group.loc[group["done"], ["chunk", "blob"]].itertuples(index=False, name=None))
        open_ = group[~group["done"]]
        if len(open_):
            parts = [_unpack(x) for x in open_["blob"]]
            doc, row, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
            content = [c for p in parts for c in _cut(p[4], p[3])]
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(c, len(number)) for c in content])
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            masks = scan_bucket(list(number), least, length, batch)
            found: list[list[tuple[int, int, int]]] = [[] for _ in parts]
            for i, (d, k) in enumerate(zip(doc.tolist(), which.tolist())):
                m = masks[k]
                r, s = int(row[i]), int(start[i])
                if d > least[k]:
                    found[owner[i]].append((r, s, s + len(m) + length - 1))
                elif m.any():
                    edge = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0))
                    found[owner[i]] += [(r, s + int(a), s + int(e) + length - 1) for a, e in zip(edge[::2], edge[1::2])]
            for chunk, f in zip(open_["chunk"], found):
                if f:
                    a = np.array(f, np.int64)
                    out.append((chunk, _pack(a[:, 0].astype(np.int32), a[:, 1], a[:, 2])))
        return pd.DataFrame(out, columns=["chunk", "blob"])

    hints = shared.unionByName(_copies(chunks, id_col, text, length), allowMissingColumns=True)
    hints = hints.groupBy("chunk").agg(F.first("keys", True).alias("keys"), F.first("copies", True).alias("copies"))
    joined = chunks.select("chunk", "rows").join(hints, "chunk").select("chunk", "rows", "keys", "copies")
    found = joined.mapInArrow(tidy(emit), "bucket long, chunk long, done boolean, blob binary")
    return found.groupBy("bucket").applyInPandas(tidy_group(meet), "chunk long, blob binary").groupBy("chunk").agg(F.collect_list("blob").alias("blobs"))


def _cut(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes.tolist())]


def merged_spans(blobs: list[bytes] | None, rows: int) -> list[list[tuple[int, int]]]:
    """Maximal ranges for each row, in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    if not blobs:
        return out
    row, start, stop = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
    for i in np.lexsort((start, row)).tolist():
        own, a, e = out[row[i]], int(start[i]), int(stop[i])
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(e, own[-1][1]))
        else:
            own.append((a, e))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, e in spans:
        parts.append(raw[at:a])
        at = e
    return b"".join([*parts, raw[at:]])


def _covered(docs: DataFrame, id_col: str, text: str, length: int, anchor: int, batch: int) -> DataFrame:
    chunks = _chunks(docs, text)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-size // PER_BUCKET))
    shared = _shared_anchors(chunks, id_col, text, length, anchor, buckets)
    spans = _spans(chunks, shared, id_col, text, length, anchor, buckets, batch)
    return chunks.select("chunk", "rows").join(spans, "chunk", "left").select("rows", "blobs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, batch: int = BATCH, spans_col: str = "removed_spans") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, and ``spans_col`` (byte ranges).

    Where a cut falls into a character, the rest of that character goes too. Null texts and rows
    without an id stay as they are, and no other row loses bytes to them; rows with equal ids lose
    nothing to each other. An existing column of that name is replaced.
    """
    keep = [c for c in docs.columns if c != spans_col]
    fields = [docs.schema[c] for c in keep]
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    arrow_spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = _rows(blob)
                at = rows.schema.get_field_index(text)
                raw = rows.column(at).cast(pa.binary()).to_pylist()
                spans = merged_spans(blobs, rows.num_rows)
                new = [t if not s else kept_bytes(t, s).decode("utf-8", "ignore").encode() for t, s in zip(raw, spans)]
                columns = [pa.array(new, pa.binary()).cast(pa.string()) if i == at else rows.column(i) for i in range(rows.num_columns)]
                listed = pa.array([[{"start": a, "stop": e} for a, e in s] for s in spans], arrow_spans)
                yield pa.RecordBatch.from_arrays([*columns, listed], names=[*keep, spans_col])

    return _covered(docs.select(*(F.col(f"`{c}`") for c in keep)), id_col, text, length, anchor, batch).mapInArrow(tidy(finish), T.StructType([*fields, T.StructField(spans_col, spans_type)]))


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batch: int = BATCH) -> DataFrame:
    """One row for each document: bytes, bytes and runs removed, and the SHA-256 of what is left."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = _rows(blob)
                raw = [t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()]
                spans = merged_spans(blobs, rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(t) for t in raw], pa.int64()),
                        pa.array([sum(e - a for a, e in s) for s in spans], pa.int64()),
                        pa.array([len(s) for s in spans], pa.int64()),
                        pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(raw, spans)]),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    joined = _covered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text", length, anchor, batch)
    return joined.mapInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
