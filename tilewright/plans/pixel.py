"""Queries: augmentation plans, pixel tables, stain jobs and batch embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilewright.functions import ids as ID
from tilewright.functions.hashing import u01
from tilewright.operators import augment as AU
from tilewright.operators import embed as EM
from tilewright.operators import ontology as O
from tilewright.operators import pixels as PX
from tilewright.operators import sample as S
from tilewright.operators import stain as ST
from tilewright.operators.aggregate import slide_profile_median
from tilewright.plans import fixtures as fx
from tilewright.plans.curate import COLOR_TOL, PALETTE, rasters
from tilewright.plans.fixtures import cte, sql_r6, sql_u, with_ctes
from tilewright.plans.registry import query
from tilewright.session import materialize

THRESHOLD, DONOR_MIN, TARGET = 3, 4, 6


@query(
    "plan_scarce_cells",
    with_ctes(
        f"""SELECT patient, label, count(*) AS n, count(*) < {THRESHOLD} AS is_target, count(*) >= {DONOR_MIN} AS is_donor
        FROM fx_a GROUP BY patient, label""",
        "fx_a",
    ),
)
def plan_scarce_cells(spark, sf):
    return AU.plan_scarce_cells(fx.patches(spark, sf), THRESHOLD, DONOR_MIN)


def _local_sql(ref: str) -> str:
    return f"""SELECT patient, slide, label, n, target, n >= 1 AND n < target AS is_source FROM (
        SELECT patient, slide, label, n, least(5, ceil({ref} OVER (PARTITION BY patient, slide) * 0.9::DOUBLE))::BIGINT AS target
        FROM (SELECT patient, slide, label, count(*) AS n FROM fx_a GROUP BY ALL))"""


@query(
    "plan_local",
    with_ctes(
        f"""SELECT 'max' AS policy, * FROM ({_local_sql('max(n)')})
        UNION ALL SELECT 'median', * FROM ({_local_sql('median(n)')})""",
        "fx_a",
    ),
)
def plan_local(spark, sf):
    a = fx.patches(spark, sf)
    cols = ["policy", "patient", "slide", "label", "n", "target", "is_source"]
    out = [
        AU.plan_local(a, 0.9, p, 5, 1).withColumn("policy", F.lit(p)).select(*cols) for p in ("max", "median")
    ]
    return out[0].unionByName(out[1])


def sources(spark, sf):
    rows = AU.scarce_sources(fx.patches(spark, sf), THRESHOLD)
    return rows.withColumn("copies", AU.copies_per_patch("n", TARGET, 1, 9, u01("copies", "name"))).drop("x")


cte(
    "fx_copies",
    f"""SELECT patient, slide, name, label, n, greatest(1, least(9, floor(per) + CASE WHEN {sql_u('copies', 'name')} < per - floor(per) THEN 1 ELSE 0 END))::INTEGER AS copies
    FROM (SELECT *, greatest(({TARGET} - n) / n::DOUBLE, 0) AS per FROM (
        SELECT *, count(*) OVER (PARTITION BY patient, label) AS n FROM fx_a) WHERE n < {THRESHOLD})""",
    "fx_a",
)


@query("copies_per_patch", with_ctes("SELECT name, n, copies FROM fx_copies", "fx_copies"))
def copies_per_patch(spark, sf):
    return sources(spark, sf).select("name", "n", "copies")


cte(
    "fx_planned",
    f"""WITH v AS (SELECT name, patient, slide, label, unnest(range(copies))::INTEGER AS j FROM fx_copies),
        d AS (SELECT name, c, m, row_number() OVER (PARTITION BY name, c ORDER BY {sql_u(42, 'name', 'c', 'm')}, m) - 1 AS place
            FROM (SELECT DISTINCT name, j // 7 AS c FROM v), (SELECT unnest(range(1, 8)) AS m))
    SELECT v.name, patient, slide, label, j, v.name || '#aug' || j AS view, m::INTEGER AS geom
    FROM v JOIN d ON v.name = d.name AND j // 7 = c AND j % 7 = place""",
    "fx_copies",
)


@query("expand_views", with_ctes("SELECT view, patient, slide, label, geom FROM fx_planned", "fx_planned"))
def expand_views(spark, sf):
    return AU.expand_views(sources(spark, sf)).select("view", "patient", "slide", "label", "geom")


@query(
    "plan_summary",
    with_ctes(
        """SELECT count(DISTINCT patient || '/' || label) AS n_cells, count(*) AS n_sources, sum(copies)::BIGINT AS n_views
        FROM fx_copies""",
        "fx_copies",
    ),
)
def plan_summary(spark, sf):
    return AU.plan_summary(sources(spark, sf), ["patient", "label"])


# --- pixels ---------------------------------------------------------------------------


_LOGS = [f"(ln(greatest({c} / 255.0::DOUBLE, 1e-6)) / ln(1e-6::DOUBLE))" for c in "rgb"]
_EOSIN = "greatest(" + " + ".join(f"{v} * ({k!r}::DOUBLE)" for v, k in zip(_LOGS, PX.EOSIN)) + ", 0)"
cte(
    "fx_qc",
    f"""SELECT *, CASE WHEN bg_frac > 0.4 THEN 'background' WHEN lowsat_frac > 0.6 THEN 'low_saturation'
            WHEN eosin_low_frac > 0.8 THEN 'low_eosin' ELSE 'ok' END AS verdict FROM (
        SELECT tile_id, avg(bg::INTEGER) AS bg_frac, avg((sat < 0.05)::INTEGER) AS lowsat_frac,
            avg((lvl < 50)::INTEGER) AS eosin_low_frac FROM (
            SELECT tile_id, (r > 230 AND g > 230 AND b > 230) OR (r < 25 AND g < 25 AND b < 25) AS bg,
                CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END AS sat,
                (e - min(e) OVER (PARTITION BY tile_id)) / (max(e) OVER (PARTITION BY tile_id) - min(e) OVER (PARTITION BY tile_id) + 1e-8) * 255 AS lvl
            FROM (SELECT *, {_EOSIN} AS e FROM fx_pixels)) GROUP BY tile_id)""",
    "fx_pixels",
)


def qc(px):
    return PX.tissue_qc(px, bg_max=0.4, lowsat_max=0.6)


@query(
    "tissue_qc",
    with_ctes(
        f"""SELECT tile_id, {sql_r6('bg_frac')} AS bg_frac, {sql_r6('lowsat_frac')} AS lowsat_frac,
            {sql_r6('eosin_low_frac')} AS eosin_low_frac, verdict FROM fx_qc""",
        "fx_qc",
    ),
)
def tissue_qc(spark, sf):
    out = qc(rasters(spark, sf))
    for c in ("bg_frac", "lowsat_frac", "eosin_low_frac"):
        out = out.withColumn(c, fx.r6(c))
    return out


SCAN_CAP = 4


@query(
    "two_phase_scan",
    with_ctes(
        f"""SELECT specimen, label, tile_id FROM (SELECT 'S' || (tile_id % 40) AS specimen, label, tile_id
            FROM fx_annotated JOIN fx_qc USING (tile_id) WHERE label IS NOT NULL AND verdict = 'ok')
        QUALIFY row_number() OVER (PARTITION BY specimen, label ORDER BY {sql_u(42, 'tile_id')}, tile_id) <= {SCAN_CAP}""",
        "fx_annotated",
        "fx_qc",
    ),
)
def two_phase_scan(spark, sf):
    cheap = O.annotate_tiles(rasters(spark, sf), PALETTE, COLOR_TOL).select(
        F.concat(F.lit("S"), (F.col("tile_id") % 40).cast("string")).alias("specimen"), "label", "tile_id"
    )

    def costly(tiles):
        return qc(rasters(spark, sf, tiles)).where("verdict = 'ok'")

    return PX.two_phase_scan(cheap, costly, SCAN_CAP).select("specimen", "label", "tile_id")


# --- images ---------------------------------------------------------------------------------

# Fixed test stains (unit length) and the 8 x 8 table of colours they make.
STAINS = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
STAINS = STAINS / np.linalg.norm(STAINS, axis=0)
SIDE = 16
COLORS = [
    [int(v) for v in np.clip(255.0 * np.exp(-(STAINS @ np.array([0.22 * h + 0.05, 0.2 * e + 0.05]))), 0, 255)]
    for h in range(8)
    for e in range(8)
]


def image_keys(spark, sf):
    """The tiles without their pixels."""
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("tile_"), k.cast("string")).alias("key"),
        F.concat(F.lit("slide-"), (k % 40).cast("string")).alias("slide"),
        F.lit(SIDE).alias("w"),
        F.lit(SIDE).alias("h"),
        k.alias("k"),
    )


def image_bytes(spark, sf, where="true"):
    """16 x 16 two-stain tiles: the colour of a pixel is a closed formula of key and place. ``where`` is on the key."""
    table = np.array(COLORS, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, v = np.arange(SIDE * SIDE) % SIDE, np.arange(SIDE * SIDE) // SIDE, np.arange(SIDE * SIDE)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                k = part.column(4).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                cell = (x * 7 + y * (k % 5 + 1) + k * 3) % 8 * 8 + (v * 5 + k + y * 3) % 8
                rgb = pa.array([t.tobytes() for t in table[cell]], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], rgb], names=["key", "slide", "w", "h", "rgb"])

    return image_keys(spark, sf).where(where).mapInArrow(run, "key string, slide string, w int, h int, rgb binary")


_HEX = [f"{r:02x}{g:02x}{b:02x}" for r, g, b in COLORS]


@query(
    "pixel_sha256",
    f"""SELECT 'tile_' || p_partkey AS key, sha256(encode('RGB:{SIDE}x{SIDE}' || chr(10)) || unhex(array_to_string(list_transform(range({SIDE * SIDE}),
        lambda v: ({_HEX})[((v % {SIDE} * 7 + v // {SIDE} * (p_partkey % 5 + 1) + p_partkey * 3) % 8 * 8
            + (v * 5 + p_partkey + v // {SIDE} * 3) % 8) + 1]), ''))) AS rgb_sha256 FROM part""",
)
def pixel_sha256(spark, sf):
    return image_bytes(spark, sf).select("key", ID.pixel_sha256("w", "h", "rgb").alias("rgb_sha256"))


cte(
    "fx_levels",
    f"""SELECT p_partkey AS k, v, c.r, c.g, c.b FROM (SELECT p_partkey, unnest(range({SIDE * SIDE})) AS v FROM part)
        JOIN (SELECT unnest(range(64)) AS i, unnest({[c[0] for c in COLORS]}) AS r, unnest({[c[1] for c in COLORS]}) AS g,
            unnest({[c[2] for c in COLORS]}) AS b) c
        ON c.i = (v % {SIDE} * 7 + v // {SIDE} * (p_partkey % 5 + 1) + p_partkey * 3) % 8 * 8 + (v * 5 + p_partkey + v // {SIDE} * 3) % 8""",
)

# Stain estimation by moments: covariance, closed-form smallest eigenvalue, normal of the stain plane,
# extreme angles around the mean density, least-squares amounts.
_DET = "(a * d * f + 2 * b * e * c - c * d * c - a * e * e - f * b * b)"
cte(
    "fx_stains",
    f"""WITH od AS MATERIALIZED (SELECT k, ln(255.0::DOUBLE) - ln(1.0::DOUBLE + r) AS x, ln(255.0::DOUBLE) - ln(1.0::DOUBLE + g) AS y,
            ln(255.0::DOUBLE) - ln(1.0::DOUBLE + b) AS z FROM fx_levels),
        t AS MATERIALIZED (SELECT * FROM od WHERE least(x, y, z) >= 0.15),
        m AS (SELECT k, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c,
            covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f FROM t GROUP BY k HAVING count(*) >= 50),
        q AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2
            + 2 * (b * b + c * c + e * e)) / 6) AS p FROM m),
        l AS (SELECT *, q + 2 * p * cos((acos(greatest(-1.0, least(1.0, (SELECT {_DET} FROM (SELECT (o.a - o.q) / o.p AS a, o.b / o.p AS b, o.c / o.p AS c,
            (o.d - o.q) / o.p AS d, o.e / o.p AS e, (o.f - o.q) / o.p AS f)) / 2)::DOUBLE)) + 2 * pi()) / 3) AS w FROM q o WHERE p >= 1e-12),
        s AS (SELECT k, mx, my, mz, a - w AS a, b, c, d - w AS d, e, f - w AS f FROM l),
        n AS (SELECT k, mx, my, mz, unnest([[b * e - c * d, c * b - a * e, a * d - b * b], [b * f - c * e, c * c - a * f, a * e - b * c],
            [d * f - e * e, e * c - b * f, b * e - d * c]]) AS v FROM s),
        u AS (SELECT k, mx, my, mz, v[1] / s AS nx, v[2] / s AS ny, v[3] / s AS nz FROM (SELECT *, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS s FROM n)
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC) = 1),
        w AS (SELECT k, nx, ny, nz, mx - nx * h AS ax, my - ny * h AS ay, mz - nz * h AS az FROM (SELECT *, nx * mx + ny * my + nz * mz AS h FROM u)),
        al AS (SELECT k, nx, ny, nz, ax / s AS ax, ay / s AS ay, az / s AS az FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS s FROM w)),
        ba AS (SELECT *, ny * az - nz * ay AS tx, nz * ax - nx * az AS ty, nx * ay - ny * ax AS tz FROM al),
        th AS (SELECT k, quantile_cont(r, [0.01, 0.99]) AS th FROM (SELECT k, atan2(x * tx + y * ty + z * tz, x * ax + y * ay + z * az) AS r FROM t JOIN ba USING (k)) GROUP BY k),
        pr AS (SELECT k, cos(th[1]) * ax + sin(th[1]) * tx AS px, cos(th[1]) * ay + sin(th[1]) * ty AS py, cos(th[1]) * az + sin(th[1]) * tz AS pz,
            cos(th[2]) * ax + sin(th[2]) * tx AS qx, cos(th[2]) * ay + sin(th[2]) * ty AS qy, cos(th[2]) * az + sin(th[2]) * tz AS qz FROM ba JOIN th USING (k)),
        he AS (SELECT k, CASE WHEN px >= qx THEN [px, qx, py, qy, pz, qz] ELSE [qx, px, qy, py, qz, pz] END AS h FROM pr),
        g AS (SELECT k, h, h[1] * h[1] + h[3] * h[3] + h[5] * h[5] AS aa, h[2] * h[2] + h[4] * h[4] + h[6] * h[6] AS bb, h[1] * h[2] + h[3] * h[4] + h[5] * h[6] AS ab FROM he),
        am AS (SELECT k, quantile_cont((bb * da - ab * db) / det, 0.99) AS m0, quantile_cont((aa * db - ab * da) / det, 0.99) AS m1 FROM (
            SELECT k, aa, bb, ab, greatest(aa * bb - ab * ab, 1e-12) AS det, x * h[1] + y * h[3] + z * h[5] AS da, x * h[2] + y * h[4] + z * h[6] AS db FROM od JOIN g USING (k)) GROUP BY k)
    SELECT p_partkey AS k, 'tile_' || p_partkey AS key, 'slide-' || (p_partkey % 40) AS slide, h, m0, m1,
        coalesce(least(m0, m1) >= 0.05 AND degrees(atan2(sqrt(greatest(aa * bb - ab * ab, 0)), abs(ab))) >= 10, false) AS valid
    FROM part LEFT JOIN g ON g.k = p_partkey LEFT JOIN am ON am.k = p_partkey""",
    "fx_levels",
)


def profiles(spark, sf):
    return ST.stain_profiles(image_bytes(spark, sf))


def _sql_profile(h: str, m0: str, m1: str) -> str:
    return ", ".join([f"{sql_r6(f'{h}[{i + 1}]')} AS h{i}" for i in range(6)] + [f"{sql_r6(m0)} AS m0", f"{sql_r6(m1)} AS m1"])


@query("stain_profiles", with_ctes(f"SELECT key, slide, valid, {_sql_profile('h', 'm0', 'm1')} FROM fx_stains", "fx_stains"))
def stain_profiles(spark, sf):
    p = profiles(spark, sf)
    return p.select(
        "key",
        "slide",
        "valid",
        *[fx.r6(F.get("he", F.lit(i))).alias(f"h{i}") for i in range(6)],
        *[fx.r6(F.get("maxc", F.lit(i))).alias(f"m{i}") for i in range(2)],
    )


def library(spark, sf):
    """Slide stain library from a per-slide sample of the tiles."""
    some = S.sample_per_slide(image_bytes(spark, sf), 12, key="key")
    return slide_profile_median(ST.stain_profiles(some), 3, 3)


def image_views(spark, sf):
    rows = image_keys(spark, sf).select("key", F.lit(2).alias("copies"))
    return AU.expand_views(rows, "copies", 42, "key").select("key", "view", "geom")


def _manifold(spark, sf, modes):
    lib = materialize(library(spark, sf), "stain-library")
    views = image_views(spark, sf)
    out = None
    for mode in modes:
        part = ST.stain_manifold_sample(views, lib, mode).select(
            F.lit(mode).alias("mode"),
            "view",
            *[fx.r6(F.get("he_t", F.lit(i))).alias(f"h{i}") for i in range(6)],
            *[fx.r6(F.get("maxc_t", F.lit(i))).alias(f"m{i}") for i in range(2)],
        )
        out = part if out is None else out.unionByName(part)
    return out


def _unit(h: str) -> str:
    """Both stains positive, the redder first, and of unit length, from a list of six."""
    n = lambda j: f"(sqrt({h}[{j}] ** 2 + {h}[{j + 2}] ** 2 + {h}[{j + 4}] ** 2) + 1e-8)"
    return "[" + ", ".join(f"{h}[{i + 1}] / {n(i % 2 + 1)}" for i in range(6)) + "]"


_ORIENT = """CASE WHEN s1 * h[1] < s2 * h[2] THEN [s2 * h[2], s1 * h[1], s2 * h[4], s1 * h[3], s2 * h[6], s1 * h[5]]
    ELSE [s1 * h[1], s2 * h[2], s1 * h[3], s2 * h[4], s1 * h[5], s2 * h[6]] END"""
_SIGNS = "CASE WHEN h[1] + h[3] + h[5] < 0 THEN -1.0::DOUBLE ELSE 1.0 END AS s1, CASE WHEN h[2] + h[4] + h[6] < 0 THEN -1.0::DOUBLE ELSE 1.0 END AS s2"
cte(
    "fx_library",
    f"""WITH part12 AS (SELECT * FROM fx_stains QUALIFY row_number() OVER (PARTITION BY slide ORDER BY {sql_u(42, 'key')}, key) <= 12),
        med AS (SELECT slide, [{", ".join(f"median(h[{i + 1}]) FILTER (valid)" for i in range(6))}] AS h, median(m0) FILTER (valid) AS m0,
            median(m1) FILTER (valid) AS m1 FROM part12 GROUP BY slide HAVING count(*) >= 3 AND count(*) FILTER (valid) >= 3),
        o AS (SELECT slide, m0, m1, {_ORIENT} AS h FROM (SELECT *, {_SIGNS} FROM med))
    SELECT row_number() OVER (ORDER BY {sql_u("library", "slide")}, slide) - 1 AS idx, count(*) OVER () AS d, slide, {_unit('h')} AS h, m0, m1 FROM o""",
    "fx_stains",
)
_DRAW = lambda name: sql_u(f"42-{name}", "view")
_MANIFOLD = f"""WITH v AS (SELECT 'tile_' || p_partkey || '#aug' || j AS view FROM part, (SELECT unnest(range(2)) AS j)),
    d AS (SELECT view, d, floor({_DRAW('i1')} * d)::BIGINT AS i1, floor({_DRAW('i2')} * (d - 1))::BIGINT AS r2, floor({_DRAW('i3')} * (d - 2))::BIGINT AS r3,
        -ln(1.0::DOUBLE - {_DRAW('w0')}) + 1e-12 AS e0, -ln(1.0::DOUBLE - {_DRAW('w1')}) + 1e-12 AS e1, -ln(1.0::DOUBLE - {_DRAW('w2')}) + 1e-12 AS e2,
        least(d, CASE WHEN {_DRAW('m')} < 0.7 THEN 2 ELSE 3 END) AS n FROM v, (SELECT count(*) AS d FROM fx_library)),
    d2 AS (SELECT *, r2 + (r2 >= i1)::BIGINT AS i2 FROM d),
    d3 AS (SELECT *, r3 + (r3 >= least(i1, i2))::BIGINT + (r3 + (r3 >= least(i1, i2))::BIGINT >= greatest(i1, i2))::BIGINT AS i3 FROM d2),
    picks AS (SELECT 'discrete' AS mode, view, i1 AS idx, 1.0::DOUBLE AS w FROM d3
        UNION ALL SELECT 'interpolate', view, i1, CASE n WHEN 1 THEN 1.0 WHEN 2 THEN e0 / (e0 + e1) ELSE e0 / (e0 + e1 + e2) END FROM d3
        UNION ALL SELECT 'interpolate', view, i2, CASE n WHEN 2 THEN e1 / (e0 + e1) ELSE e1 / (e0 + e1 + e2) END FROM d3 WHERE n >= 2
        UNION ALL SELECT 'interpolate', view, i3, e2 / (e0 + e1 + e2) FROM d3 WHERE n >= 3),
    mix AS (SELECT mode, view, [{", ".join(f"sum(h[{i + 1}] * w)" for i in range(6))}] AS h, exp(sum(ln(greatest(m0, 1e-6)) * w)) AS m0,
        exp(sum(ln(greatest(m1, 1e-6)) * w)) AS m1 FROM picks JOIN fx_library USING (idx) GROUP BY mode, view),
    o AS (SELECT mode, view, m0, m1, {_ORIENT} AS h FROM (SELECT mode, view, m0, m1, h, {_SIGNS} FROM (SELECT mode, view, m0, m1, {_unit('h')} AS h FROM mix)))
SELECT mode, view, {_sql_profile('h', 'm0', 'm1')} FROM o"""


@query("stain_manifold_sample", with_ctes(_MANIFOLD, "fx_library"))
def stain_manifold_sample(spark, sf):
    return _manifold(spark, sf, ("discrete", "interpolate"))


@query("stain_manifold_pca")
def stain_manifold_pca(spark, sf):
    """Draws from the principal space of the library; checked by unit tests."""
    return _manifold(spark, sf, ("pca",))


def augmented(spark, sf):
    lib = materialize(library(spark, sf), "stain-library")
    views = ST.stain_manifold_sample(image_views(spark, sf), lib, "interpolate")
    return ST.stain_transfer(image_bytes(spark, sf), views)


@query("stain_transfer")
def stain_transfer(spark, sf):
    return augmented(spark, sf).select("view", "w", "h", "how", F.sha2("rgb", 256).alias("rgb_sha256"))


_BLOCKS = f"""WITH m AS (SELECT k, (v // {SIDE} // 4) * 4 + v % {SIDE} // 4 AS blk, avg(r / 255.0::DOUBLE) AS r, avg(g / 255.0::DOUBLE) AS g, avg(b / 255.0::DOUBLE) AS b
        FROM fx_levels GROUP BY ALL),
    f AS (SELECT k, unnest([blk * 3, blk * 3 + 1, blk * 3 + 2]) AS i, unnest([r, g, b]) AS v FROM m),
    y AS (SELECT k, j, sum(v * cos(0.7::DOUBLE * i * (j + 1) + 0.3::DOUBLE * j))::FLOAT::DOUBLE AS y FROM f, (SELECT unnest(range(32)) AS j) GROUP BY k, j),
    n AS (SELECT k, j, y / (sqrt(sum(y * y) OVER (PARTITION BY k)) + 1e-8) AS y FROM y)
SELECT 'tile_' || k AS key, NULL::VARCHAR AS error, array_to_string(list((round(y, 4) + 0.0)::DECIMAL(9, 4)::VARCHAR ORDER BY j), ',') AS x
FROM n WHERE k % 10 <> 3 GROUP BY k"""


@query("embed_batch", with_ctes(_BLOCKS, "fx_levels"))
def embed_batch(spark, sf):
    """Embed the tiles that an earlier run has not embedded yet."""
    imgs = image_bytes(spark, sf)
    done = image_keys(spark, sf).where(F.substring("key", -1, 1) == "3").select("key")
    parts = F.transform("x", lambda v: (F.round(v.cast("double"), 4) + 0.0).cast("decimal(9,4)").cast("string"))
    return EM.embed_batch(imgs, EM.ProjectionEncoder(32), done).select("key", "error", F.array_join(parts, ",").alias("x"))


def angle_between(a, b) -> float:
    """Degrees between two vectors; used by tests on recovered stains."""
    return math.degrees(math.acos(min(1.0, abs(float(np.dot(a, b)) / (np.linalg.norm(a) * np.linalg.norm(b))))))
