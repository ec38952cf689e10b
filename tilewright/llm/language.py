"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. A trigram is
bound from its letters, each rotated by its place: ``rot2(a) * rot1(b) * c``. A document is the
bundle (sum) of its trigrams, a language the bundle of its training documents, and a document gets
the language whose prototype has the largest cosine.

Text is lower-cased; a run of other characters than letters counts as one gap symbol, and so does the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import tidy

DIMENSIONS = 1024
SEED = 20240501
UNKNOWN = "und"
#: Characters handled at once; longer texts are taken piece by piece and their counts added.
BLOCK = 1 << 19
#: Rows of a block, and trigrams whose counts and vectors are held at a time.
ROWS, GRAMS = 256, 4096
GAP = 32

_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """One row of +1 and -1 for each code point, the same in every task."""
    rows = [np.random.default_rng([seed, int(p)]).integers(0, 2, dimensions, np.int8) for p in points]
    return np.array(rows, np.int8).reshape(len(points), dimensions) * 2 - 1


@dataclass
class Profiler:
    """Turns texts into bundles of trigram vectors."""

    dimensions: int = DIMENSIONS
    seed: int = SEED
    letters: dict[int, np.ndarray] = field(default_factory=dict)

    def _vectors(self, points: np.ndarray) -> np.ndarray:
        new = [p for p in points.tolist() if p not in self.letters]
        self.letters.update(zip(new, letter_vectors(np.array(new, np.int64), self.dimensions, self.seed)))
        return np.array([self.letters[p] for p in points.tolist()])

    def _added(self, pieces: list[tuple[int, str]], out: np.ndarray) -> None:
        """Add the bundles of the pieces to their rows of ``out``; no trigram spans two pieces.

        Counts (rows x trigrams) and the trigrams' vectors are made for ``GRAMS`` trigrams at a time.
        """
        points = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat([r for r, _ in pieces], [len(p) for _, p in pieces])
        piece = np.repeat(np.arange(len(pieces)), [len(p) for _, p in pieces])
        letter = _is_letter()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of other characters
        symbols, letter, owner, piece = points[keep], letter[keep], owner[keep], piece[keep]
        symbols = np.where(letter, symbols, GAP)
        if len(symbols) < 3:
            return
        seen = np.flatnonzero(np.bincount(symbols))
        index = np.zeros(seen[-1] + 1, np.int64)
        index[seen] = np.arange(len(seen))
        s, n = index[symbols], len(seen)
        grams = ((s[:-2] * n + s[1:-1]) * n + s[2:])[piece[:-2] == piece[2:]]
        owner = owner[:-2][piece[:-2] == piece[2:]]
        if n**3 <= 1 << 22:
            known = np.flatnonzero(np.bincount(grams, minlength=1))
            place = np.zeros(n**3, np.int64)
            place[known] = np.arange(len(known))
            local = place[grams]
        else:
            known, local = np.unique(grams, return_inverse=True)
        v = self._vectors(seen)
        first, second = np.roll(v, 2, 1), np.roll(v, 1, 1)
        rows = len(out)
        for at in range(0, len(known), GRAMS):
            some = known[at : at + GRAMS]
            mine = slice(None) if len(known) <= GRAMS else (local >= at) & (local < at + GRAMS)
            counts = np.bincount(owner[mine] * len(some) + (local[mine] - at), minlength=rows * len(some))
            bound = first[some // (n * n)] * second[some // n % n] * v[some % n]
            out += counts.reshape(rows, len(some)).astype(out.dtype) @ bound.astype(np.float32)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[tuple[int, str]]]]:
        """Whole texts in blocks of about BLOCK characters and at most ROWS rows: the rows, and (row in block, piece)."""
        rows, pieces, size = [], [], 0
        for i, text in enumerate(texts):
            low = (text or "").lower()
            rows.append(i)
            at, end = 0, BLOCK
            while end < len(low):
                if low[end].isalpha():
                    # a piece starts at a letter; with two characters of the next one, trigrams across the cut count, too
                    pieces.append((len(rows) - 1, low[at : min(at + BLOCK + 1, end)] + low[end : end + 2].ljust(2, "\n")))
                    at, end = end, end + BLOCK
                else:
                    end += 1
            pieces.append((len(rows) - 1, low[at : at + BLOCK + 1] + "\n"))
            size += len(low)
            if size >= BLOCK or len(rows) >= ROWS:
                yield rows, pieces
                rows, pieces, size = [], [], 0
        if rows:
            yield rows, pieces

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A bundle for each text; all zero where the text is null or has fewer than two letters."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for rows, pieces in self.blocks(texts):
            for part in _parts(pieces):
                self._added(part, out[rows[0] : rows[-1] + 1])  # rows of a block lie in a row
        return out

    def sums(self, texts: list[str | None], classes: np.ndarray, n: int) -> np.ndarray:
        """The bundles added up by class, without making each of them."""
        out = np.zeros((n, self.dimensions), np.float64)
        for rows, pieces in self.blocks(texts):
            for part in _parts([(int(classes[rows[r]]), p) for r, p in pieces]):
                self._added(part, out)
        return out


def _parts(pieces: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Pieces in lots of bounded size."""
    lot, size = [], 0
    for p in pieces:
        lot.append(p)
        size += len(p[1])
        if size >= BLOCK:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most twice ROWS rows: as many texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 2 * ROWS):
            yield b.slice(at, 2 * ROWS)


@dataclass
class Prototypes:
    """Languages in alphabetical order and a unit vector for each."""

    languages: list[str]
    vectors: np.ndarray
    dimensions: int = DIMENSIONS
    seed: int = SEED


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Prototypes:
    """Prototypes from all rows that have a text and a language.

    Tasks add up their documents by language; the driver gets one vector for each language. Without
    such rows there is no language.
    """

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, total = Profiler(dimensions, seed), {}
        for b in _slices(batches):
            names, classes = np.unique(np.array(b.column(1).to_pylist(), dtype=object), return_inverse=True)
            for name, row in zip(names, maker.sums(b.column(0).to_pylist(), classes, len(names))):
                total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(row)],
                names=["lang", "place", "value"],
            )

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    sums = known.mapInArrow(tidy(partials), "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions
        whole.setdefault(r.lang, np.zeros(dimensions))[r.place] = r.value
    whole = {k: v for k, v in sorted(whole.items()) if np.any(v)}
    unit = [v / np.linalg.norm(v) for v in whole.values()]
    return Prototypes(list(whole), np.array(unit, np.float32).reshape(len(unit), dimensions), dimensions, seed)


def identify(docs: DataFrame, model: Prototypes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``.

    ``score`` is the cosine with the best prototype, at least 0; ties go to the first language by
    name. A null text, one without a letter, or an empty model gives ``und`` and 0. A text with
    letters but no trigram gets the first language and 0. Columns of the input that bear the new
    names are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, vectors, dims, seed = np.array(model.languages, object), model.vectors, model.dimensions, model.seed
    shown = [F.col(f"`{c}`") for c in keep]
    place = keep.index(text) if text in keep else len(keep)  # a text that stays is sent once

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, letters = Profiler(dims, seed), _is_letter()
        for b in _slices(batches):
            texts = b.column(place).to_pylist()
            bundles = maker.bundles(texts)
            norms = np.linalg.norm(bundles, axis=1)
            if len(names):
                cosines = bundles @ vectors.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(1)
                score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
                lang = names[best]
            else:
                score, lang = np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object)
            for i in np.flatnonzero(norms == 0):  # nothing to compare, but there may be a letter
                score[i] = 0.0
                if not any(letters[ord(c)] for c in texts[i] or ""):
                    lang[i] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(lang.tolist(), pa.string()), pa.array(score)],
                names=[*keep, "lang_pred", "score"],
            )

    return docs.select(*shown, *([] if text in keep else [F.col(text).alias("__text")])).mapInArrow(tidy(tag), out)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, then tag every document."""
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text", "lang")
    model = fit(rows.where(~F.col("held_out")))
    return identify(rows, model, keep=["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in which a language is found; ``und`` goes. The columns stay as they are."""
    model = fit(docs.where(~held_out("doc_id")))
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))  # whatever their names are
    tagged = identify(plain, model, f"c{docs.columns.index('text')}").where(F.col("lang_pred") != UNKNOWN)
    return tagged.select(*(F.col(f"c{i}").alias(c, metadata=docs.schema[i].metadata) for i, c in enumerate(docs.columns)))
