"""Tissue structures, annotation palettes and their classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def structure_to_class(name, acronym, variant: str = "strict") -> Column:
    """Class of a tissue structure, NULL when it has none.

    The test order matters: perinecrotic tissue must not match necrosis.  The
    ``strict`` variant goes by name for classes whose acronyms collide with
    other ontologies; ``loose`` also accepts those acronyms.
    """
    if variant not in ("strict", "loose"):
        raise ValueError(f"unknown variant {variant!r}")
    n = F.lower(F.coalesce(_col(name), F.lit("")))
    a = F.coalesce(_col(acronym), F.lit(""))
    loose = F.lit(variant == "loose")
    none = F.lit(None).cast("string")
    return (
        F.when(n.contains("pseudopalis") | a.isin("CTpan", "CTpnn"), "PN")
        .when(n.contains("microvascular") | (a == "CTmvp"), "MP")
        .when(n.contains("perinecrotic") | (a == "CTpnz"), none)
        .when(n.contains("necrosis") | n.contains("necrotic") | (a == "CTne"), "NC")
        .when(n.contains("cellular tumor") | (loose & (a == "CT")), "CT")
        .when(n.contains("infiltrating tumor") | (loose & (a == "IT")), "IC")
        .otherwise(none)
    )


def build_palette(structures: DataFrame, variant: str = "strict") -> DataFrame:
    """Structures with a six-digit colour and a class: rgb, class, original order."""
    hexa = F.col("color_hex")

    def channel(i: int) -> Column:
        return F.conv(F.substring(hexa, i, 2), 16, 10).cast("int")

    return (
        structures.where(F.length(hexa) == 6)
        .withColumn("cls", structure_to_class("name", "acronym", variant))
        .where(F.col("cls").isNotNull())
        .select("ord", channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"), "acronym", "name", "cls")
    )


def graph_vote(probes: DataFrame, per_probe: bool = False) -> DataFrame:
    """Most frequent ontology graph over the probe hits; ``per_probe`` counts a graph
    once per probe.  Ties go to the smaller id."""
    hits = probes.where(F.col("graph_id").isNotNull())
    if per_probe:
        hits = hits.select("probe", "graph_id").distinct()
    return (
        hits.groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("votes"))
        .orderBy(F.desc("votes"), "graph_id")
        .limit(1)
    )


def nearest_palette(r, g, b, palette: list[tuple[int, int, int, str]], tol: float) -> Column:
    """Class of the nearest palette colour within ``tol``; the first entry wins ties.

    The palette is a parameter of a few dozen colours, so it becomes a literal and
    no join is needed.
    """
    if not palette:
        return F.lit(None).cast("string")
    entries = F.array(
        *[
            F.struct(
                F.lit(pr).alias("r"), F.lit(pg).alias("g"), F.lit(pb).alias("b"), F.lit(c).alias("cls")
            )
            for pr, pg, pb, c in palette
        ]
    )

    def scored(e: Column, i: Column) -> Column:
        dr, dg, db = _col(r) - e["r"], _col(g) - e["g"], _col(b) - e["b"]
        return F.struct((dr * dr + dg * dg + db * db).alias("d2"), i.alias("i"), e["cls"].alias("cls"))

    best = F.array_min(F.transform(entries, scored))
    return F.when(best["d2"] <= F.lit(float(tol) * float(tol)), best["cls"])


class ColorCube:
    """Nearest palette entry of every colour, filled as colours come up; -1 beyond ``tol``.

    One 16-bit cell for each of the 2^24 colours (32 MB for a worker). Squared distances are integers, so
    ties are exact and go to the first entry.
    """

    UNKNOWN = -2

    def __init__(self, palette: list[tuple[int, int, int, str]], tol: float):
        self.rgb = np.array([e[:3] for e in palette], dtype=np.int64).reshape(-1, 3)
        self.limit = float(tol) * float(tol)
        self.cells = np.full(1 << 24, self.UNKNOWN, dtype=np.int16)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Entry numbers of packed colours."""
        new = np.unique(codes[self.cells[codes] == self.UNKNOWN])
        for part in np.array_split(new, -(-len(new) // 65_536)) if len(new) else ():
            self.cells[part] = self._nearest(part)
        return self.cells[codes]

    def _nearest(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.rgb):
            return np.full(len(codes), -1)
        d2 = ((unpack(codes)[:, None, :] - self.rgb[None]) ** 2).sum(axis=2)
        best = d2.argmin(axis=1)
        return np.where(d2[np.arange(len(codes)), best] <= self.limit, best, -1)


def packed(rgb: bytes) -> np.ndarray:
    """The pixels of a raster as 24-bit colours."""
    px = np.frombuffer(rgb, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    return px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]


def unpack(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1)


def is_raster(tiles: DataFrame) -> bool:
    """Whether tiles come with their bytes (column ``rgb``), not as one row for each pixel."""
    return "rgb" in tiles.columns


def raster_colors(
    tiles: DataFrame, palette: list[tuple[int, int, int, str]], tol: float, by: list[str]
) -> DataFrame:
    """(by, r, g, b, n, cls): the colours of each tile with their class, from its own bytes.

    A missing raster counts as an empty one. Rows of one key must be one tile.
    """
    classes = np.array([*(e[3] for e in palette), None], dtype=object)  # -1 is the last
    kept = tiles.select(*by, "rgb")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "rgb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cube = ColorCube(palette, tol)
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                out = []
                for row in pdf.iloc[lo : lo + 64].itertuples(index=False):
                    codes, n = np.unique(packed(row[-1] or b""), return_counts=True)
                    rgb = unpack(codes)
                    cols = {"r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "n": n, "cls": classes[cube.of(codes)]}
                    out.append(pd.DataFrame({**{k: [v] * len(codes) for k, v in zip(by, row)}, **cols}))
                yield pd.concat(out)

    return kept.mapInPandas(run, f"{schema}, r int, g int, b int, n long, cls string")


def raster_votes(tiles: DataFrame, palette: list[tuple[int, int, int, str]], tol: float) -> DataFrame:
    """One row for each tile: tile_id, pixels, annotated pixels and the top class, ties to the first by name.

    A tile without pixels has no row.
    """
    names = sorted({e[3] for e in palette})
    entry = np.array([*(names.index(e[3]) for e in palette), len(names)])  # -1 is the last
    kept = tiles.select("tile_id", "rgb").where("length(rgb) > 0")
    kind = kept.schema["tile_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cube = ColorCube(palette, tol)
        for pdf in batches:
            votes = np.zeros((len(pdf), len(names) + 1), dtype=np.int64)
            for i, rgb in enumerate(pdf["rgb"]):
                votes[i] = np.bincount(entry[cube.of(packed(rgb))], minlength=len(names) + 1)
            seen = votes[:, :-1]
            best = seen.argmax(axis=1) if names else np.zeros(len(pdf), dtype=np.int64)
            ann = seen.sum(axis=1)
            top = seen[np.arange(len(pdf)), best] if names else ann
            cls = [names[b] if a else None for b, a in zip(best, ann)]
            yield pd.DataFrame({"tile_id": pdf["tile_id"], "_all": votes.sum(axis=1), "_ann": ann, "_n": top, "_cls": cls})

    return kept.mapInPandas(run, f"tile_id {kind}, _all long, _ann long, _n long, _cls string")


def nearest_color_join(
    pixels: DataFrame, palette: list[tuple[int, int, int, str]], tol: float = 30.0, by: list[str] | None = None
) -> DataFrame:
    """Pixel colours counted per ``by`` group, each with its palette class.

    Tiles with an ``rgb`` column are counted in place; pixel rows are grouped.
    """
    keys = by or ["tile_id"]
    if is_raster(pixels):
        return raster_colors(pixels, palette, tol, keys)
    return (
        pixels.groupBy(*keys, "r", "g", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cls", nearest_palette("r", "g", "b", palette, tol))
    )


def annotate_tiles(
    pixels: DataFrame,
    palette: list[tuple[int, int, int, str]],
    tol: float = 30.0,
    min_coverage: float = 0.5,
    purity: float = 0.7,
) -> DataFrame:
    """Label tiles from annotation pixels: coverage gate, then purity of the top class.

    Tiles with an ``rgb`` column are labelled in place, without a shuffle; pixel rows are grouped.
    """
    if is_raster(pixels):
        tiles = raster_votes(pixels, palette, tol)
    else:
        tiles = _pixel_votes(pixels, palette, tol)
    cov, frac = F.col("coverage"), F.col("top_frac")
    return (
        tiles.withColumn("coverage", F.col("_ann") / F.col("_all"))
        .withColumn("top_frac", F.when(F.col("_ann") > 0, F.col("_n") / F.col("_ann")))
        .withColumn(
            "reason",
            F.when(cov < min_coverage, "low_coverage").when(frac < purity, "mixed").otherwise("ok"),
        )
        .select(
            "tile_id",
            "coverage",
            F.when(cov >= min_coverage, frac).alias("top_frac"),
            "reason",
            F.when(F.col("reason") == "ok", F.col("_cls")).alias("label"),
        )
    )


def _pixel_votes(pixels: DataFrame, palette: list[tuple[int, int, int, str]], tol: float) -> DataFrame:
    """As ``raster_votes``, from one row for each pixel."""
    votes = nearest_color_join(pixels, palette, tol).groupBy("tile_id", "cls").agg(F.sum("n").alias("n"))
    # Struct order: most pixels first, then the alphabetically first class.
    top = F.min(F.when(F.col("cls").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("cls"))))
    annotated = F.coalesce(F.sum(F.when(F.col("cls").isNotNull(), F.col("n"))), F.lit(0))
    tiles = votes.groupBy("tile_id").agg(F.sum("n").alias("_all"), annotated.alias("_ann"), top.alias("_top"))
    return tiles.select("tile_id", "_all", "_ann", (-F.col("_top.m")).alias("_n"), F.col("_top.cls").alias("_cls"))
