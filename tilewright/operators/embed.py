"""Batch embedding with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.vectors import l2_normalize
from tilewright.operators.joins import anti_join_done


class Encoder(Protocol):
    """``open`` loads the model once per task; ``encode`` maps raw images to a matrix.

    An undecodable image may raise; it is then reported in the ``error`` column.
    """

    def open(self) -> None: ...

    def encode(self, images: list[tuple[int, int, bytes]]) -> np.ndarray: ...


def check_encoder(encoder) -> None:
    missing = [m for m in ("open", "encode") if not callable(getattr(encoder, m, None))]
    if missing:
        raise TypeError(f"encoder lacks {missing}")


class ProjectionEncoder:
    """Deterministic stand-in for a vision model: a cosine projection of block means."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def open(self) -> None:
        i = np.arange(48)[:, None]
        j = np.arange(self.dim)[None, :]
        self.basis = np.cos(0.7 * i * (j + 1) + 0.3 * j)

    def encode(self, images: list[tuple[int, int, bytes]]) -> np.ndarray:
        feats = []
        for w, h, rgb in images:
            img = np.frombuffer(rgb, dtype=np.uint8)
            if img.size != w * h * 3:
                raise ValueError(f"expected {w * h * 3} bytes, got {img.size}")
            img = img.reshape(h, w, 3) / 255.0
            blocks = [
                b.mean(axis=(0, 1)) for rows in np.array_split(img, 4, axis=0) for b in np.array_split(rows, 4, axis=1)
            ]
            feats.append(np.concatenate(blocks))
        return np.stack(feats) @ self.basis


def embed_batch(
    images: DataFrame,
    encoder: Encoder,
    done: DataFrame | None = None,
    key: str = "key",
    normalize: bool = True,
) -> DataFrame:
    """(key, x, error) for images (key, w, h, rgb) that ``done`` does not hold yet.

    Resuming is an anti join ahead of the Python stage.  A batch that fails is retried
    image by image, so one bad image costs only itself.
    """
    check_encoder(encoder)
    todo = images if done is None else anti_join_done(images, done, [key])

    def attempt(items: list[tuple[int, int, bytes]]):
        try:
            return [(v.tolist(), None) for v in np.asarray(encoder.encode(items), dtype=np.float32)]
        except Exception as e:
            if len(items) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [r for it in items for r in attempt([it])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder.open()
        for pdf in batches:
            if not len(pdf):
                continue
            got = attempt(list(zip(pdf["w"], pdf["h"], pdf["rgb"])))
            yield pd.DataFrame({key: pdf[key], "x": [g[0] for g in got], "error": [g[1] for g in got]})

    out = todo.select(key, "w", "h", "rgb").mapInPandas(run, f"{key} string, x array<float>, error string")
    return out.withColumn("x", l2_normalize("x")) if normalize else out


def split_failures(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine rows with the error); write the input out first, both
    sides read it."""
    good = embedded.where(F.col("error").isNull()).drop("error")
    bad = embedded.where(F.col("error").isNotNull()).drop("x")
    return good, bad
