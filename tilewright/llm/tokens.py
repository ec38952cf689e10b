"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

``byte_bpe_50k.json`` first splits a text into pieces, and no piece reaches over a space that has a
character other than white space on one side at least: the piece before ends there and the next one starts with
that space. Such a place is a stable boundary: the tokens on either side do not depend on the other.

- Ordinary texts are cut at stable boundaries, and the count of each part is remembered.
- A text over ``HUGE`` characters is encoded in overlapping chunks with offsets. Two neighbours are
  spliced at a stable boundary inside their overlap at which both have a token edge; where there is
  none, the overlap is widened, up to the whole rest of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import TABLES

FILE, LIMIT = "byte_bpe_50k.json", 512
HUGE, CHUNK, OVERLAP = 50_000, 16_384, 256
#: Parts whose counts a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64

_UNSTABLE = re.compile(r"\s \s")
_STABLE = re.compile(r"(?<=\S) | (?=\S)")
_known: dict[str, object] = {}
TABLES.append(_known)


def tokenizer(path: str):
    """One instance for each worker."""
    if path not in _known:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _known[path] = t
    return _known[path]


def installed(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str) -> list[str]:
    """The text cut before every space; spaces in a run of white space do not cut."""
    if _UNSTABLE.search(text):
        at = [m.start() for m in _STABLE.finditer(text)]
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)]) if b > a]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + r for r in rest]


def spliced(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a long text. ``encode`` gives ids and the offsets of their ends."""
    out: list[int] = []
    begin = 0
    ids, ends = encode(text[:chunk])
    stop = min(chunk, len(text))
    while stop < len(text):
        wide = overlap
        while True:
            start = max(begin + 1, stop - wide)
            to = min(len(text), start + max(chunk, 2 * wide))
            nxt_ids, nxt_ends = encode(text[start:to])
            edges = {begin + e: i + 1 for i, e in enumerate(ends)}
            nxt_edges = {start + e: i + 1 for i, e in enumerate(nxt_ends)} | {start: 0}
            # a boundary needs the characters on both sides, so the first and the last place do not count
            cut = next((m.start() for m in _STABLE.finditer(text, start, stop) if start < m.start() < stop - 1 and m.start() in edges and m.start() in nxt_edges), None)
            if cut is not None:
                out += ids[: edges[cut]]
                ids, ends, begin = nxt_ids[nxt_edges[cut] :], [e + start - cut for e in nxt_ends[nxt_edges[cut] :]], cut
                stop = to
                break
            if start == begin + 1:  # nothing left to widen: take more text to the right
                ids, ends = encode(text[begin : min(len(text), begin + 2 * (stop - begin) + chunk)])
                stop = min(len(text), begin + 2 * (stop - begin) + chunk)
                break
            wide *= 2
    return out + ids


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.known: dict[str, int] = _known.setdefault(path + " counts", {})

    def _ends(self, text: str) -> tuple[list[int], list[int]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut, out = [], []
        for t in texts:
            cut.append(parts(t) if t and len(t) <= HUGE else [])
        new = list({p for c in cut for p in c if p not in self.known})
        fresh = {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        for t, c in zip(texts, cut):
            if t and len(t) > HUGE:
                out.append(len(spliced(t, self._ends)))
            else:
                out.append(sum(fresh[p] if p in fresh else self.known[p] for p in c))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST)
        return out


def count_tokens(docs: DataFrame, text: str = "text", file: str = FILE, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) in place of the text; a null or empty text has none.

    ``path`` defaults to the installed vocabulary's place on each executor. Special strings inside a
    text count as the library reads them by default. An existing column ``n_tokens`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "n_tokens")]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(path or installed(file))
        for b in batches:
            at, column = 0, b.column(b.num_columns - 1)
            done: list[int] = []
            per = max(1, int(b.num_rows * (2 << 20) / max(column.nbytes, 1)))
            while at < b.num_rows:
                done += counter.counts(column.slice(at, per).to_pylist())
                at += per
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(done, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`")).mapInArrow(count, schema)


def document_tokens(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(rows).withColumn("over_limit", F.col("n_tokens") > limit)
