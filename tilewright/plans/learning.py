"""Queries: vector functions, head scoring, calibration, fitting, registries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import ids as ID
from tilewright.functions import masks as M
from tilewright.functions import vectors as VX
from tilewright.operators import calibrate as C
from tilewright.operators import ensemble as EN
from tilewright.operators import evaluate as E
from tilewright.operators import folds as FO
from tilewright.operators import heads as H
from tilewright.operators import registry as R
from tilewright.plans import fixtures as fx
from tilewright.plans.curate import aligned, all_sources, ext, ext_all, ext_table
from tilewright.plans.fixtures import cte, sql_l2, sql_r6, sql_u, sql_vec, with_ctes
from tilewright.plans.registry import query

N = 10
X_COLS = {s: f"x_{s}" for s in "abc"}
DIMS = {"a": 64, "b": 32, "c": 32}

# --- vector functions ------------------------------------------------------------------

_SCALED = f"list_transform(x, lambda v: (v * ({fx.SQL_VEC_NO} % 4))::FLOAT)"
from tilewright.session import materialize


@query(
    "l2_normalize",
    with_ctes(f"SELECT name, {sql_vec(sql_l2('s'))} AS x FROM (SELECT name, {_SCALED} AS s FROM fx_a)", "fx_a"),
)
def l2_normalize(spark, sf):
    k = (fx.vec_no() % 4).cast("float")
    scaled = fx.patches(spark, sf).withColumn("x", F.transform("x", lambda v: v * k))
    return scaled.select("name", fx.vec_text(VX.l2_normalize("x")).alias("x"))


@query(
    "match_representation",
    with_ctes(
        f"""SELECT mode, name, {sql_vec('x')} AS x FROM (
            SELECT 'auto' AS mode, name, {sql_l2('t')} AS x FROM (SELECT name, list_transform(x, lambda v: (v * 3)::FLOAT) AS t FROM fx_views)
            UNION ALL SELECT 'none', name, list_transform(x, lambda v: (v * 3)::FLOAT) FROM fx_views)""",
        "fx_views",
    ),
)
def match_representation(spark, sf):
    foreign = fx.views(spark, sf).withColumn("x", F.transform("x", lambda v: (v * 3).cast("float")))
    home = fx.patches(spark, sf)
    out = [
        EN.match_representation(foreign, home, m).select(
            F.lit(m).alias("mode"), "name", fx.vec_text("x").alias("x")
        )
        for m in ("auto", "none")
    ]
    return out[0].unionByName(out[1])


@query(
    "concat_sources",
    with_ctes(
        f"""SELECT name, {sql_vec(f'list_concat({sql_l2("x_a")}, {sql_l2("x_b")}, {sql_l2("x_c")})')} AS x FROM fx_aligned""",
        "fx_aligned",
    ),
)
def concat_sources(spark, sf):
    return aligned(spark, sf).select("name", fx.vec_text(VX.concat_sources(X_COLS)).alias("x"))


@query(
    "chunk_slices",
    with_ctes(
        f"""SELECT name, start, stop, {sql_vec('x[start + 1 : stop]')} AS chunk FROM fx_a,
            (VALUES (0, 30), (30, 60)) AS c(start, stop)""",
        "fx_a",
    ),
)
def chunk_slices(spark, sf):
    return VX.chunk_slices(fx.patches(spark, sf), "x", 30, 16).select(
        "name", "start", "stop", fx.vec_text("chunk").alias("chunk")
    )


@query(
    "pool_crops",
    with_ctes(
        f"""WITH m AS (SELECT name, x, list_transform(range(16), lambda i:
                ((x[i + 1]::DOUBLE + x[i + 17]::DOUBLE + x[i + 33]::DOUBLE + x[i + 49]::DOUBLE) / 4)::FLOAT) AS mean FROM fx_a)
        SELECT name, {sql_vec('x')} AS percrop, {sql_vec(sql_l2('mean'))} AS mean, {sql_vec(sql_l2('x'))} AS concat FROM m""",
        "fx_a",
    ),
)
def pool_crops(spark, sf):
    crops = F.array(*[F.slice("x", 1 + 16 * i, 16) for i in range(4)])
    d = fx.patches(spark, sf).withColumn("crops", crops)
    return d.select(
        "name",
        fx.vec_text(F.flatten(VX.pool_crops("crops", "percrop"))).alias("percrop"),
        fx.vec_text(VX.pool_crops("crops", "mean")).alias("mean"),
        fx.vec_text(VX.pool_crops("crops", "concat")).alias("concat"),
    )


@query(
    "permute_features",
    with_ctes(
        f"""WITH p AS (SELECT foundation, i, row_number() OVER (PARTITION BY foundation
                ORDER BY {sql_u(42, 'foundation', 'i')}, i) AS place FROM (
                SELECT foundation, unnest(range(d)) AS i FROM (VALUES ('a', 64), ('b', 32)) AS t(foundation, d)))
        SELECT foundation, name, array_to_string(list(CAST(round(x[i + 1]::DOUBLE * 1e6) AS BIGINT) ORDER BY place), ',') AS x
        FROM (SELECT * FROM fx_a UNION ALL SELECT * FROM fx_b) JOIN p USING (foundation) GROUP BY foundation, name""",
        "fx_a",
        "fx_b",
    ),
)
def permute_features(spark, sf):
    both = fx.patches(spark, sf, "a").unionByName(fx.patches(spark, sf, "b"))
    out = M.permute_features(both, {"a": 64, "b": 32})
    return out.select("foundation", "name", fx.vec_text("x").alias("x"))


_HOME_U, _MASK_U = sql_u("42-home", "'a'", "i"), sql_u(42, "'a'", "k", "i")


@query(
    "feature_masks",
    with_ctes(
        f"""WITH c AS (SELECT i, row_number() OVER (ORDER BY {_HOME_U}, i) - 1 AS place FROM (SELECT unnest(range(64)) AS i)),
            m AS (SELECT unnest(range(4)) AS k),
            masks AS (SELECT 'balanced' AS scheme, k, i FROM c, m WHERE (place - k * 16 + 64) % 64 < 26
                UNION ALL SELECT 'random', k, i FROM c, m
                    QUALIFY row_number() OVER (PARTITION BY k ORDER BY place % 4 <> k, {_MASK_U}, i) <= 26)
        SELECT scheme, name, k::INTEGER AS mask, count(*)::INTEGER AS width,
            array_to_string(list(CAST(round(x[i + 1]::DOUBLE * 1e6) AS BIGINT) ORDER BY i), ',') AS x
        FROM fx_a, masks GROUP BY scheme, name, k""",
        "fx_a",
    ),
)
def feature_masks(spark, sf):
    d = fx.patches(spark, sf).select("name", "x")
    out = []
    for scheme in ("random", "balanced"):
        masks = M.feature_masks(64, 4, 0.4, 16, scheme, 42, "a")
        out.append(
            M.apply_masks(d, masks).select(
                F.lit(scheme).alias("scheme"), "name", "mask", F.size("x").alias("width"), fx.vec_text("x").alias("x")
            )
        )
    return out[0].unionByName(out[1])


@query(
    "parse_nested_json",
    """WITH raw AS (SELECT event_id, CASE event_id % 5
            WHEN 0 THEN '{"structure": {"acronym": "CT", "name": "Cellular Tumor"}, "area": "' || user_id || '.5"}'
            WHEN 1 THEN '{"structure": null, "area": ' || user_id || '}'
            WHEN 2 THEN '{"structure": {"acronym": "LE"}, "area": "n/a"}'
            WHEN 3 THEN '{"area": null}' ELSE props END AS raw FROM events)
    SELECT event_id, json_extract_string(raw, '$.structure.acronym') AS acronym,
        json_extract_string(raw, '$.structure.name') AS structure_name,
        try_cast(json_extract_string(raw, '$.area') AS DOUBLE) AS area FROM raw""",
)
def parse_nested_json(spark, sf):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    raw = (
        F.when(e % 5 == 0, F.concat(F.lit('{"structure": {"acronym": "CT", "name": "Cellular Tumor"}, "area": "'), u, F.lit('.5"}')))
        .when(e % 5 == 1, F.concat(F.lit('{"structure": null, "area": '), u, F.lit("}")))
        .when(e % 5 == 2, F.lit('{"structure": {"acronym": "LE"}, "area": "n/a"}'))
        .when(e % 5 == 3, F.lit('{"area": null}'))
        .otherwise(F.col("props"))
    )
    return ID.parse_nested_json(fx.table(spark, sf, "events").select("event_id", raw.alias("raw")))


_ALPHA = """CASE WHEN p_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 17 = 0 THEN 'inf'::DOUBLE
    ELSE (p_size + 1) * (CASE p_partkey % 5 WHEN 0 THEN 1e-5::DOUBLE WHEN 1 THEN 1e-4::DOUBLE WHEN 2 THEN 0.5::DOUBLE
        WHEN 3 THEN 1e7::DOUBLE ELSE 1e15::DOUBLE END) END"""
_NUM = """CASE WHEN isnan(alpha) THEN '"__NaN__"' WHEN isinf(alpha) THEN '"__Infinity__"' ELSE alpha::VARCHAR END"""


@query(
    "config_ids",
    f"""WITH t AS (SELECT p_partkey, p_name, p_brand, {_ALPHA} AS alpha, p_size FROM part)
    SELECT p_partkey, substr(sha1('{{"alpha":' || {_NUM} || ',"config_name":"' || p_name || '","foundation":"' || p_brand ||
        '","n_splits":' || p_size || ',"transform":null}}'), 1, 12) AS config_id FROM t""",
)
def config_ids(spark, sf):
    p = F.col("p_partkey")
    scale = F.when(p % 5 == 0, 1e-5).when(p % 5 == 1, 1e-4).when(p % 5 == 2, 0.5).when(p % 5 == 3, 1e7).otherwise(1e15)
    alpha = (
        F.when(p % 13 == 0, float("nan")).when(p % 17 == 0, float("inf")).otherwise((F.col("p_size") + 1) * scale)
    )
    fields = {
        "config_name": ID.json_string("p_name"),
        "foundation": ID.json_string("p_brand"),
        "alpha": ID.json_number(alpha),
        "n_splits": F.col("p_size").cast("string"),
        "transform": F.lit("null"),
    }
    return fx.table(spark, sf, "part").select("p_partkey", ID.config_id(fields).alias("config_id"))


@query(
    "input_fingerprint",
    with_ctes(
        """WITH e AS (SELECT source_dir, filename || chr(0) || size_bytes || chr(0) || mtime_s AS e,
                ('0x' || substr(md5(filename), 1, 8))::UBIGINT % 64 AS b FROM fx_files),
            l AS (SELECT source_dir, b, sha1(string_agg(e, chr(0) ORDER BY e)) AS d, count(*) AS n FROM e GROUP BY source_dir, b)
        SELECT source_dir, sum(n)::BIGINT AS n_files, sha1(string_agg(d, chr(0) ORDER BY b)) AS fingerprint FROM l GROUP BY source_dir""",
        "fx_files",
    ),
)
def input_fingerprint(spark, sf):
    return ID.input_fingerprint(fx.files(spark, sf), ["source_dir"], name="filename", buckets=64)


# --- a fixed head table ------------------------------------------------------------------

_SLOTS = [
    (s, k, start) for s, d in DIMS.items() for k in ("logistic", "ridge") for start in range(0, d, fx.CHUNK)
]


def heads(spark) -> DataFrame:
    """Heads from a closed formula; one ridge head has never seen class 9."""
    slot = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), F.lit(b).alias("start"))
                for s, k, b in _SLOTS
            ]
        )
    )
    start, cls = F.col("start"), F.col("cls")
    return (
        spark.range(1)
        .select(slot.alias("h"))
        .select("h.*", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("cls"))
        .where(~((F.col("source") == "a") & (F.col("kind") == "ridge") & (start == 0) & (cls == 9)))
        .select(
            "source",
            "kind",
            "start",
            (start + fx.CHUNK).alias("stop"),
            "cls",
            F.transform(
                F.sequence(start, start + fx.CHUNK - 1),
                lambda i: ((i * 7 + cls * 13) % 11 - 5) / F.lit(10.0),
            ).alias("coef"),
            ((cls - 4.5) / 20.0).alias("intercept"),
        )
    )


cte(
    "fx_heads",
    f"""SELECT source, kind, start, start + 16 AS stop, cls,
        list_transform(range(start, start + 16), lambda i: ((i * 7 + cls * 13) % 11 - 5) / 10.0::DOUBLE) AS coef,
        (cls - 4.5::DOUBLE) / 20.0::DOUBLE AS intercept
    FROM (VALUES {', '.join(f"('{s}', '{k}', {b})" for s, k, b in _SLOTS)}) AS s(source, kind, start),
        (SELECT unnest(range(10))::INTEGER AS cls)
    WHERE NOT (source = 'a' AND kind = 'ridge' AND start = 0 AND cls = 9)""",
)
cte(
    "fx_wide",
    """SELECT name, patient, label, 'a' AS source, x_a AS x FROM fx_aligned
    UNION ALL SELECT name, patient, label, 'b', x_b FROM fx_aligned
    UNION ALL SELECT name, patient, label, 'c', x_c FROM fx_aligned""",
    "fx_aligned",
)


def _posterior_sql(rows: str, keys: str) -> str:
    """Posteriors per (keys, source, kind, start, cls) of rows (keys, source, x)."""
    return f"""WITH z AS (SELECT {keys}, r.source, s.kind, s.start, c.cls,
            list_dot_product(r.x[s.start + 1 : s.start + 16]::DOUBLE[], h.coef) + h.intercept AS z
        FROM {rows} r JOIN (SELECT DISTINCT source, kind, start FROM fx_heads) s ON r.source = s.source
            CROSS JOIN (SELECT unnest(range(10))::INTEGER AS cls) c
            LEFT JOIN fx_heads h ON h.source = s.source AND h.kind = s.kind AND h.start = s.start AND h.cls = c.cls),
        e AS (SELECT *, CASE WHEN kind = 'logistic' THEN CASE WHEN z IS NULL THEN 0 ELSE 1 / (1 + exp(-z)) END
            ELSE exp(coalesce(z, -20) - max(coalesce(z, -20)) OVER (PARTITION BY {keys}, source, kind, start)) END AS e FROM z)
        SELECT {keys}, source, kind, start, cls, e / sum(e) OVER (PARTITION BY {keys}, source, kind, start) AS p FROM e"""


def _source_mean_sql(posterior: str, keys: str) -> str:
    return f"""WITH s AS (SELECT {keys}, source, cls, avg(p) AS p FROM {posterior} GROUP BY ALL),
        n AS (SELECT {keys}, cls, avg(p / t) AS p FROM (SELECT *, sum(p) OVER (PARTITION BY {keys}, source) AS t FROM s) GROUP BY ALL)
        SELECT {keys}, cls, p / sum(p) OVER (PARTITION BY {keys}) AS p FROM n"""


cte("fx_posterior", _posterior_sql("fx_wide", "name"), "fx_wide", "fx_heads")
cte("fx_ensemble", _source_mean_sql("fx_posterior", "name"), "fx_posterior")


def _long(df: DataFrame, proba: str = "proba", *keep: str) -> DataFrame:
    """Posterior arrays as (keys, cls, p) rows, rounded."""
    return df.select(*keep, F.posexplode(proba).alias("cls", "p")).withColumn("p", fx.r6("p"))


@query(
    "score_linear_heads",
    with_ctes(
        f"SELECT name, source, kind, start, cls, {sql_r6('p')} AS p FROM fx_posterior", "fx_posterior"
    ),
)
def score_linear_heads(spark, sf):
    rows, hs = aligned(spark, sf), heads(spark)
    parts = [
        H.score_linear_heads(rows.select("name", F.col(f"x_{s}").alias("x")), hs, s) for s in "abc"
    ]
    return _long(reduce(DataFrame.unionByName, parts), "proba", "name", "source", "kind", "start")


WEIGHTS = {"a": 1.0, "b": 2.0, "c": 0.5}


@query(
    "ensemble_head_mean",
    with_ctes(
        f"""WITH w AS (SELECT name, cls, sum(w * p) / sum(w) AS p FROM (SELECT *, CASE source WHEN 'a' THEN 1.0::DOUBLE
                WHEN 'b' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM fx_posterior) GROUP BY name, cls)
        SELECT name, cls, {sql_r6('p / sum(p) OVER (PARTITION BY name)')} AS p FROM w""",
        "fx_posterior",
    ),
)
def ensemble_head_mean(spark, sf):
    bank = H.head_bank(heads(spark))
    p = H.ensemble_proba(bank, X_COLS, "head_mean", WEIGHTS)
    return _long(aligned(spark, sf).select("name", p.alias("proba")), "proba", "name")


def scored(spark, sf, **tta) -> DataFrame:
    """Aligned rows with raw ensemble posteriors."""
    p = H.ensemble_proba(H.head_bank(heads(spark)), X_COLS, **tta)
    return aligned(spark, sf).select("name", "patient", F.col("label").cast("int").alias("y"), p.alias("proba"))


@query("ensemble_source_mean", with_ctes(f"SELECT name, cls, {sql_r6('p')} AS p FROM fx_ensemble", "fx_ensemble"))
def ensemble_source_mean(spark, sf):
    return _long(scored(spark, sf), "proba", "name")


RARE = [2, 7]
THRESHOLDS = [1.0, 0.95, 1.1, 0.98, 1.03, 0.9, 1.05, 1.02, 1.0, 0.97]
cte(
    "fx_boosted",
    """SELECT name, cls, q / sum(q) OVER (PARTITION BY name) AS p FROM (
        SELECT name, cls, p * (CASE WHEN cls IN (2, 7) THEN 1.1::DOUBLE ELSE 1 END) AS q FROM fx_ensemble)""",
    "fx_ensemble",
)


@query("rare_boost", with_ctes(f"SELECT name, cls, {sql_r6('p')} AS p FROM fx_boosted", "fx_boosted"))
def rare_boost(spark, sf):
    out = scored(spark, sf).withColumn("proba", H.rare_boost("proba", RARE, 1.1))
    return _long(out, "proba", "name")


@query(
    "apply_thresholds",
    with_ctes(
        f"""WITH t AS (SELECT name, cls, p / ({THRESHOLDS})[cls + 1]::DOUBLE AS q FROM fx_boosted),
            n AS (SELECT name, cls, q / sum(q) OVER (PARTITION BY name) AS p FROM t)
        SELECT name, arg_min(cls, -p * 1e9 + cls * 1e-9) AS pred, {sql_r6('max(p)')} AS top FROM n GROUP BY name""",
        "fx_boosted",
    ),
)
def apply_thresholds(spark, sf):
    p = H.apply_thresholds(H.rare_boost("proba", RARE, 1.1), THRESHOLDS)
    out = scored(spark, sf).withColumn("proba", p)
    return out.select("name", E.argmax("proba").alias("pred"), fx.r6(F.array_max("proba")).alias("top"))


GRID = 11
_GRID_SQL = "[" + ", ".join(f"{v!r}::DOUBLE" for v in C.threshold_grid(GRID)) + "]"


def _f1_of(t_list: str) -> str:
    """Macro F1 (classes seen) of rows (cand, y, p list) under thresholds ``t_list``."""
    return f"""SELECT cand, sum(f1) / count(*) AS score FROM (
            SELECT cand, cls, 2.0::DOUBLE * count(*) FILTER (y = cls AND pred = cls) / (count(*) FILTER (y = cls) + count(*) FILTER (pred = cls)) AS f1
            FROM (SELECT cand, y, list_position(q, list_max(q)) - 1 AS pred FROM (
                SELECT cand, y, list_transform(range(10), lambda k: p[k + 1] / {t_list}[k + 1]) AS q FROM rows_c)),
                (SELECT unnest(range(10)) AS cls) WHERE y = cls OR pred = cls GROUP BY cand, cls) GROUP BY cand"""


cte(
    "fx_cal",
    """SELECT label::INTEGER AS y, p FROM (SELECT name, list(p ORDER BY cls) AS p FROM fx_ensemble GROUP BY name)
        JOIN fx_aligned USING (name)""",
    "fx_ensemble",
    "fx_aligned",
)


@query(
    "tune_thresholds_step",
    with_ctes(
        f"""WITH rows_c AS (SELECT i AS cand, y, p, list_concat([{_GRID_SQL}[i + 1]], list_transform(range(9), lambda k: 1.0::DOUBLE)) AS t
            FROM fx_cal, (SELECT unnest(range({GRID})) AS i))
        SELECT cand::INTEGER AS candidate, {sql_r6(f'{_GRID_SQL}[cand + 1]')} AS threshold, {sql_r6('score')} AS macro_f1
        FROM ({_f1_of('t')})""",
        "fx_cal",
    ),
)
def tune_thresholds_step(spark, sf):
    """Macro F1 of every candidate for class 0 with all other thresholds at one."""
    grid = C.threshold_grid(GRID)
    counts = C.candidate_counts(scored(spark, sf), [1.0] * N, 0, grid)
    rows = [tuple(r) for r in counts.collect()]
    f1 = C.candidate_f1(rows, 0, GRID)
    return spark.createDataFrame(
        [(i, round(g, 6) + 0.0, round(s, 6) + 0.0) for i, (g, s) in enumerate(zip(grid, f1))],
        "candidate int, threshold double, macro_f1 double",
    )


def _tune_sql() -> str:
    """The greedy search as a chain of CTEs, one per class."""
    steps = [
        "s0 AS (SELECT list_transform(range(10), lambda k: 1.0::DOUBLE) AS t, (SELECT score FROM ("
        + _f1_of("t").replace(
            "rows_c", "(SELECT 0 AS cand, y, p, list_transform(range(10), lambda k: 1.0::DOUBLE) AS t FROM fx_cal)"
        )
        + ")) AS best)"
    ]
    for c in range(N):
        rows = (
            f"(SELECT i AS cand, y, p, list_transform(range(10), lambda k: CASE WHEN k = {c} THEN {_GRID_SQL}[i + 1] "
            f"ELSE s{c}.t[k + 1] END) AS t FROM fx_cal, s{c}, (SELECT unnest(range({GRID})) AS i))"
        )
        steps.append(f"c{c} AS MATERIALIZED ({_f1_of('t').replace('rows_c', rows)})")
        steps.append(
            f"""s{c + 1} AS MATERIALIZED (SELECT CASE WHEN m > best + 1e-12 THEN list_transform(range(10), lambda k: CASE WHEN k = {c}
                THEN {_GRID_SQL}[first_i + 1] ELSE t[k + 1] END) ELSE t END AS t, greatest(m, best) AS best
            FROM s{c}, (SELECT max(score) AS m, (SELECT min(cand) FROM c{c} WHERE score > (SELECT max(score) FROM c{c}) - 1e-12) AS first_i FROM c{c}))"""
        )
    return f"""WITH {', '.join(steps)}
        SELECT k::INTEGER AS cls, {sql_r6('t[k + 1]')} AS threshold, {sql_r6('best')} AS macro_f1 FROM s{N}, (SELECT unnest(range(10)) AS k)"""


@query("tune_thresholds", with_ctes(_tune_sql(), "fx_cal"))
def tune_thresholds(spark, sf):
    rows = scored(spark, sf)
    t = C.tune_thresholds(rows, GRID, passes=1)
    best = C.candidate_f1(
        [tuple(r) for r in C.candidate_counts(rows, t, 0, [t[0]]).collect()], 0, 1
    )[0]
    return spark.createDataFrame(
        [(c, round(v, 6) + 0.0, round(best, 6) + 0.0) for c, v in enumerate(t)],
        "cls int, threshold double, macro_f1 double",
    )


PASSES = 16


def _mix(col: str, table: str, keep: str) -> str:
    """Murmur3 finaliser over ``col`` in steps, result in ``bits``."""
    m = "4294967295::UBIGINT"
    return f"""SELECT {keep}, xor(k2, k2 >> 16) AS bits FROM (
        SELECT {keep}, (xor(k1, k1 >> 13) * 3266489909::UBIGINT) & {m} AS k2 FROM (
        SELECT {keep}, (xor({col}, {col} >> 16) * 2246822507::UBIGINT) & {m} AS k1 FROM {table}))"""


def _lane(salt: int, passes: int) -> str:
    seeds = f"""(SELECT p, i, xor((i + p * 65536)::UBIGINT, {salt}::UBIGINT) AS k0 FROM
        (SELECT unnest(range(1, {passes + 1})) AS p), (SELECT unnest(range(64)) AS i))"""
    return _mix("k0", seeds, "p, i")


def _bits(salt: int, passes: int) -> str:
    keyed = f"""(SELECT name, source, p, i, xor(h, bits) AS k0 FROM
        (SELECT name, source, len(x) AS d, {fx.sql_hash32(42, 'source', 'name')} AS h FROM fx_wide)
        JOIN ({_lane(salt, passes)}) ON i < d)"""
    return _mix("k0", keyed, "name, source, p, i")


_LIMIT = int(round(0.9 * 2**32))
cte(
    "fx_masked",
    f"""SELECT name, source, p, list(CASE WHEN bits < {_LIMIT} THEN x[i + 1]::DOUBLE ELSE 0 END / 0.9::DOUBLE ORDER BY i) AS x
    FROM ({_bits(0, PASSES)}) JOIN fx_wide USING (name, source) GROUP BY name, source, p
    UNION ALL SELECT name, source, 0, x::DOUBLE[] FROM fx_wide""",
    "fx_wide",
)
cte("fx_masked_posterior", _posterior_sql("(SELECT name, p AS pass, source, x FROM fx_masked)", "name, pass"), "fx_masked", "fx_heads")
cte("fx_masked_ensemble", _source_mean_sql("fx_masked_posterior", "name, pass"), "fx_masked_posterior")


@query(
    "tta_scores",
    with_ctes(
        f"SELECT name, cls, {sql_r6('avg(p)')} AS p FROM fx_masked_ensemble GROUP BY name, cls", "fx_masked_ensemble"
    ),
)
def tta_scores(spark, sf):
    return _long(scored(spark, sf, passes=PASSES, keep=0.9), "proba", "name")


NOISE_PASSES = 3
cte(
    "fx_noisy",
    f"""SELECT name, source, p, list(CASE WHEN m < {_LIMIT} THEN x[i + 1]::DOUBLE ELSE 0 END / 0.9::DOUBLE + 0.5::DOUBLE * (std + 1e-6)
            * sqrt(-2 * ln((u1 + 1.0::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (u2 / 4294967296.0::DOUBLE)) ORDER BY i) AS x
    FROM (SELECT name, source, p, i, bits AS m FROM ({_bits(0, NOISE_PASSES)}))
        JOIN (SELECT name, source, p, i, bits AS u1 FROM ({_bits(0x5BD1E995, NOISE_PASSES)})) USING (name, source, p, i)
        JOIN (SELECT name, source, p, i, bits AS u2 FROM ({_bits(0x1B873593, NOISE_PASSES)})) USING (name, source, p, i)
        JOIN (SELECT source, i, stddev_pop(v) AS std FROM (SELECT source, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) - 1 AS i FROM fx_wide)
            GROUP BY source, i) USING (source, i)
        JOIN fx_wide USING (name, source) GROUP BY name, source, p
    UNION ALL SELECT name, source, 0, x::DOUBLE[] FROM fx_wide""",
    "fx_wide",
)
cte("fx_noisy_posterior", _posterior_sql("(SELECT name, p AS pass, source, x FROM fx_noisy)", "name, pass"), "fx_noisy", "fx_heads")
cte("fx_noisy_ensemble", _source_mean_sql("fx_noisy_posterior", "name, pass"), "fx_noisy_posterior")


def wide_std(rows: DataFrame) -> dict[str, list[float]]:
    """Feature deviations per source of aligned rows: one small row per source."""
    from tilewright.operators.aggregate import feature_moments

    long = reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(s).alias("foundation"), F.col(c).alias("x")) for s, c in X_COLS.items()],
    )
    return {r["foundation"]: [v + 1e-6 for v in r["std"]] for r in feature_moments(long).collect()}


@query(
    "tta_noise",
    with_ctes(
        f"SELECT name, cls, {sql_r6('avg(p)')} AS p FROM fx_noisy_ensemble GROUP BY name, cls", "fx_noisy_ensemble"
    ),
)
def tta_noise(spark, sf):
    std = wide_std(aligned(spark, sf))
    return _long(scored(spark, sf, passes=NOISE_PASSES, keep=0.9, noise=0.5, std=std), "proba", "name")


@query(
    "compare_predictions",
    with_ctes(
        f"""WITH t AS (SELECT name, cls, avg(p) AS p FROM fx_masked_ensemble GROUP BY name, cls),
            r AS (SELECT name, arg_min(e.cls, -e.p * 1e9 + e.cls * 1e-9) <> arg_min(e.cls, -t.p * 1e9 + e.cls * 1e-9) AS flip,
                sum(abs(e.p - t.p)) AS sd, max(abs(e.p - t.p)) AS md FROM fx_ensemble e JOIN t USING (name, cls) GROUP BY name)
        SELECT count(*) AS n_rows, count(*) FILTER (flip) AS n_flips, {sql_r6('1 - avg(flip::INTEGER)')} AS agreement,
            {sql_r6('sum(sd) / (count(*) * 10)')} AS mean_abs_diff, {sql_r6('max(md)')} AS max_abs_diff,
            count(*) FILTER (md > 1e-6) AS n_rows_changed FROM r""",
        "fx_masked_ensemble",
        "fx_ensemble",
    ),
)
def compare_predictions(spark, sf):
    out = E.compare_predictions(scored(spark, sf), scored(spark, sf, passes=PASSES, keep=0.9))
    for c in ("agreement", "mean_abs_diff", "max_abs_diff"):
        out = out.withColumn(c, fx.r6(c))
    return out


# --- fitting --------------------------------------------------------------------------------


def _head_rows(h: DataFrame) -> DataFrame:
    return h.select("source", "kind", "start", "stop", "cls", fx.vec_text("coef").alias("coef"), fx.r6("intercept").alias("intercept"))


@query("fit_ridge_wide")
def fit_ridge_wide(spark, sf):
    """Chunks of production shape; ``fit_ridge_heads`` checks the same solver in closed form."""
    return _head_rows(H.fit_ridge_heads(all_sources(spark, sf), size=16))


GRADIENT_TOL = 2e-4


@query(
    "fit_logistic_heads",
    with_ctes(
        """WITH u AS (SELECT foundation AS source, label, len(x) AS d FROM fx_a UNION ALL SELECT foundation, label, len(x) FROM fx_b
                UNION ALL SELECT foundation, label, len(x) FROM fx_c),
            h AS (SELECT DISTINCT source, label, d FROM u WHERE label >= 0)
        SELECT source, unnest(range(0, d, 32))::INTEGER AS start, label::INTEGER AS cls, true AS stationary FROM h""",
        "fx_a",
        "fx_b",
        "fx_c",
    ),
)
def fit_logistic_heads(spark, sf):
    """Heads of all sources, held against their optimality condition: the penalised gradient vanishes."""
    rows = all_sources(spark, sf).where("label >= 0")
    alpha = 3e-5
    heads = materialize(H.fit_logistic_heads(rows, size=32, alpha=alpha), "logistic")
    n = rows.groupBy("foundation", "label").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(W.partitionBy("foundation"))).withColumn("k", F.count(F.lit(1)).over(W.partitionBy("foundation")))
    balance = n.select(F.col("foundation").alias("source"), F.col("label").cast("int").alias("cls"), "total", (F.col("total") / (F.col("k") * F.col("n"))).alias("w"))
    h = heads.join(balance, ["source", "cls"])
    x = F.transform(F.slice("x", F.col("start") + 1, F.col("stop") - F.col("start")), lambda v: v.cast("double"))
    z = F.aggregate(F.zip_with("xs", "coef", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    hit = F.col("label") == F.col("cls")
    each = (
        rows.withColumnRenamed("foundation", "source").join(h, "source").withColumn("xs", x)
        .withColumn("wt", F.when(hit, F.col("w")).otherwise(1.0))
        .withColumn("r", F.col("wt") * (1.0 / (1.0 + F.exp(-z)) - hit.cast("double")))
    )
    slope = each.select("source", "start", "cls", "coef", "total", "wt", "r", F.posexplode("xs").alias("j", "v"))
    per_dim = slope.groupBy("source", "start", "cls", "j").agg(
        (F.abs(F.sum(F.col("r") * F.col("v")) / F.sum("wt") + alpha * F.first("total") / F.sum("wt") * F.first(F.get("coef", "j")))).alias("g"),
        F.abs(F.sum("r") / F.sum("wt")).alias("g0"),
    )
    return per_dim.groupBy("source", "start", "cls").agg((F.greatest(F.max("g"), F.max("g0")) < GRADIENT_TOL).alias("stationary"))


@query("fit_lda_wide")
def fit_lda_wide(spark, sf):
    """One chunk for each source; ``fit_shrinkage_lda`` checks the same solver in closed form."""
    return _head_rows(H.fit_shrinkage_lda(all_sources(spark, sf)))


# Two dims to a chunk: the normal equations have a closed form that SQL can write down.
cte(
    "fx_pairs",
    """WITH u AS (SELECT foundation, label, x FROM fx_a UNION ALL SELECT foundation, label, x FROM fx_b UNION ALL SELECT foundation, label, x FROM fx_c),
        n AS (SELECT foundation, label, count(*) AS n FROM u WHERE label >= 0 GROUP BY ALL),
        w AS (SELECT foundation, label, n, sum(n) OVER (PARTITION BY foundation) / (count(*) OVER (PARTITION BY foundation) * n::DOUBLE) AS w FROM n),
        c AS (SELECT foundation, label, x, unnest(range(0, len(x), 2)) AS start FROM u WHERE label >= 0)
    SELECT c.foundation AS source, start::INTEGER AS start, label, w, n, x[start + 1]::DOUBLE AS x1, x[start + 2]::DOUBLE AS x2
    FROM c JOIN w USING (foundation, label)""",
    "fx_a",
    "fx_b",
    "fx_c",
)


def _sql_heads(kind: str) -> str:
    coef = "CAST(round(k1 * 1e6) AS BIGINT) || ',' || CAST(round(k2 * 1e6) AS BIGINT)"
    return f"""SELECT source, '{kind}' AS kind, start, (start + 2)::INTEGER AS stop, label::INTEGER AS cls, {coef} AS coef, {sql_r6('icpt')} AS intercept FROM solved"""


_RIDGE_SQL = f"""WITH g AS (SELECT source, start, sum(w) AS sw, sum(w * x1) AS s1, sum(w * x2) AS s2, sum(w * x1 * x1) AS s11, sum(w * x1 * x2) AS s12,
            sum(w * x2 * x2) AS s22 FROM fx_pairs GROUP BY ALL),
        c AS (SELECT source, start, label, sum(w) AS n, sum(w * x1) AS c1, sum(w * x2) AS c2 FROM fx_pairs GROUP BY ALL),
        m AS (SELECT *, s1 / sw AS m1, s2 / sw AS m2, (2 * n - sw) / sw AS my FROM g JOIN c USING (source, start)),
        e AS (SELECT *, s11 - sw * m1 * m1 + 10 AS a11, s12 - sw * m1 * m2 AS a12, s22 - sw * m2 * m2 + 10 AS a22,
            2 * c1 - s1 - sw * m1 * my AS b1, 2 * c2 - s2 - sw * m2 * my AS b2 FROM m),
        k AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS k1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS k2 FROM e),
        solved AS (SELECT *, my - m1 * k1 - m2 * k2 AS icpt FROM k)
    {_sql_heads('ridge')}"""


@query("fit_ridge_heads", with_ctes(_RIDGE_SQL, "fx_pairs"))
def fit_ridge_heads(spark, sf):
    return _head_rows(H.fit_ridge_heads(all_sources(spark, sf), size=2, min_dim=2))


_LDA_SQL = f"""WITH p AS (SELECT * FROM fx_pairs WHERE n >= 2),
        c AS (SELECT source, start, label, count(*) AS n, avg(x1) AS u1, avg(x2) AS u2 FROM p GROUP BY ALL),
        g AS (SELECT source, start, count(*) AS t, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22 FROM p GROUP BY ALL),
        d AS (SELECT source, start, sum(n * u1 * u1) AS d11, sum(n * u1 * u2) AS d12, sum(n * u2 * u2) AS d22, max(n) AS most FROM c GROUP BY ALL),
        v AS (SELECT source, start, most, (s11 - d11) / greatest(t - 1, 1) AS v11, (s12 - d12) / greatest(t - 1, 1) AS v12, (s22 - d22) / greatest(t - 1, 1) AS v22
            FROM g JOIN d USING (source, start)),
        h AS (SELECT source, start, most, 0.9 * v11 + 0.05 * (v11 + v22) AS a11, 0.9 * v12 AS a12, 0.9 * v22 + 0.05 * (v11 + v22) AS a22 FROM v),
        k AS (SELECT *, (a22 * u1 - a12 * u2) / (a11 * a22 - a12 * a12) AS k1, (a11 * u2 - a12 * u1) / (a11 * a22 - a12 * a12) AS k2 FROM c JOIN h USING (source, start)),
        solved AS (SELECT *, -0.5 * (u1 * k1 + u2 * k2) + ln(n::DOUBLE / most) AS icpt FROM k)
    {_sql_heads('lda')}"""


@query("fit_shrinkage_lda", with_ctes(_LDA_SQL, "fx_pairs"))
def fit_shrinkage_lda(spark, sf):
    return _head_rows(H.fit_shrinkage_lda(all_sources(spark, sf), size=2))


# Unit vectors of the sources side by side, two dims to a chunk.
cte(
    "fx_stacked_pairs",
    f"""WITH u AS (SELECT 'stacked' AS foundation, label, list_concat(list_concat({sql_l2('x_a')}, {sql_l2('x_b')}), {sql_l2('x_c')}) AS x FROM fx_aligned WHERE label >= 0),
        n AS (SELECT label, count(*) AS n FROM u GROUP BY ALL)
    SELECT foundation AS source, start::INTEGER AS start, label, n, x[start + 1]::DOUBLE AS x1, x[start + 2]::DOUBLE AS x2
    FROM (SELECT foundation, label, x, unnest(range(0, len(x), 2)) AS start FROM u) JOIN n USING (label)""",
    "fx_aligned",
)


@query("fit_stacked_lda", with_ctes(_LDA_SQL.replace("fx_pairs", "fx_stacked_pairs"), "fx_stacked_pairs"))
def fit_stacked_lda(spark, sf):
    return _head_rows(H.fit_stacked_lda(aligned(spark, sf), list(X_COLS.values()), size=2))


# The training side of each of three folds, as a source of its own.
cte(
    "fx_fold_pairs",
    """WITH r AS (SELECT * FROM fx_a UNION ALL SELECT * FROM fx_b UNION ALL SELECT * FROM fx_c),
        u AS (SELECT foundation || ':' || k AS foundation, label, x FROM r JOIN (SELECT unnest(range(3)) AS k) ON CAST(right(patient, 3) AS INTEGER) % 3 <> k
            WHERE label >= 0),
        n AS (SELECT foundation, label, count(*) AS n FROM u GROUP BY ALL),
        w AS (SELECT foundation, label, n, sum(n) OVER (PARTITION BY foundation) / (count(*) OVER (PARTITION BY foundation) * n::DOUBLE) AS w FROM n),
        c AS (SELECT foundation, label, x, unnest(range(0, len(x), 2)) AS start FROM u)
    SELECT c.foundation AS source, start::INTEGER AS start, label, w, n, x[start + 1]::DOUBLE AS x1, x[start + 2]::DOUBLE AS x2
    FROM c JOIN w USING (foundation, label)""",
    "fx_a",
    "fx_b",
    "fx_c",
)


@query(
    "oof_heads",
    with_ctes(
        f"SELECT * FROM ({_RIDGE_SQL}) UNION ALL SELECT * FROM ({_LDA_SQL})".replace("fx_pairs", "fx_fold_pairs"),
        "fx_fold_pairs",
    ),
)
def oof_heads(spark, sf):
    """Ridge and discriminant heads without each fold, the moments of all folds from one scan."""
    rows = reduce(DataFrame.unionByName, [fx.patches(spark, sf, s) for s in "abc"])
    rows = rows.withColumn("fold", F.substring("patient", -3, 3).cast("int") % 3)
    heads = H.ridge_heads_by_fold(rows, size=2, min_dim=2).unionByName(H.lda_heads_by_fold(rows, size=2))
    return _head_rows(heads.withColumn("source", F.concat_ws(":", "source", "fold")).drop("fold"))


SHARPNESS = 8.0


def centroid_heads(rows: DataFrame, size: int, min_dim: int) -> DataFrame:
    """An own fitter: the nearest class mean as linear heads over whole vectors."""
    vector = array_to_vector(F.transform("x", lambda v: v.cast("double")))
    means = rows.where("label >= 0").groupBy("foundation", "label").agg(vector_to_array(Summarizer.mean(vector)).alias("m"))
    half = F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v) * 0.5
    return means.select(
        F.col("foundation").alias("source"),
        F.lit("centroid").alias("kind"),
        F.lit(0).alias("start"),
        F.size("m").alias("stop"),
        F.col("label").cast("int").alias("cls"),
        F.transform("m", lambda v: v * SHARPNESS).alias("coef"),
        (half * -SHARPNESS).alias("intercept"),
    )


cte(
    "fx_centroid_posterior",
    f"""WITH d AS (SELECT source, label, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) AS i FROM fx_wide WHERE label >= 0),
        m AS (SELECT source, label, i, avg(v) AS m FROM d GROUP BY ALL),
        h AS (SELECT source, label AS cls, list(m ORDER BY i) AS coef, -0.5 * sum(m * m) AS icpt FROM m GROUP BY ALL),
        z AS (SELECT name, w.source, c.cls, {SHARPNESS} * (list_dot_product(w.x::DOUBLE[], h.coef) + h.icpt) AS z FROM fx_wide w
            CROSS JOIN (SELECT unnest(range(10))::INTEGER AS cls) c LEFT JOIN h ON h.source = w.source AND h.cls = c.cls),
        e AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE exp(z - max(z) OVER (PARTITION BY name, source)) END AS e FROM z)
    SELECT name, source, cls, e / sum(e) OVER (PARTITION BY name, source) AS p FROM e""",
    "fx_wide",
)
cte("fx_centroid_ensemble", _source_mean_sql("fx_centroid_posterior", "name"), "fx_centroid_posterior")


@query(
    "own_estimator",
    with_ctes(f"SELECT name, cls, {sql_r6('p')} AS p FROM fx_centroid_ensemble", "fx_centroid_ensemble"),
)
def own_estimator(spark, sf):
    """The whole ensemble with a fitter of the caller's, without calibration and boost."""
    base = {s: fx.patches(spark, sf, s) for s in "abc"}
    model = EN.ensemble_fit(base, calibration=0.0, boost=1.0, kinds=(centroid_heads,))
    return _long(model.predict(aligned(spark, sf), X_COLS), "proba", "name")


@query("ensemble_fit")
def ensemble_fit(spark, sf):
    """Fit logistic heads and ridge probes with extra rows, then predict: the decision per row."""
    base = {s: fx.patches(spark, sf, s) for s in "abc"}
    extra = fx.views(spark, sf)
    model = EN.ensemble_fit(base, extra, size=16, grid_size=7, kinds=("logistic", "ridge"))
    out = model.predict(aligned(spark, sf), X_COLS)
    return out.select("name", "pred", fx.r6(F.array_max("proba")).alias("top"))


@query("oof_run")
def oof_run(spark, sf):
    base = {s: fx.patches(spark, sf, s) for s in "abc"}
    folds = FO.fold_table(base["b"], 3, forced=("patient-007", "patient-013"))
    from tilewright.session import materialize

    oof = EN.oof_run(base, materialize(folds, "folds"), "standard", size=32, grid_size=5)
    return oof.select("name", "patient", "fold", "y", E.argmax("proba").alias("pred"))


@query(
    "heads_export",
    with_ctes(
        """WITH s AS (SELECT foundation AS source, label FROM fx_a UNION ALL SELECT foundation, label FROM fx_b
                UNION ALL SELECT foundation, label FROM fx_c),
            c AS (SELECT source, count(DISTINCT label) AS n_classes, array_to_string(list_sort(list(DISTINCT label)), ',') AS classes
                FROM s GROUP BY source)
        SELECT source, 'ridge' AS kind, start, start + 16 AS stop, n_classes, classes, true AS dims_ok, 'probe' AS role
        FROM c JOIN (VALUES ('a', 0), ('a', 16), ('a', 32), ('a', 48), ('b', 0), ('b', 16), ('c', 0), ('c', 16)) AS v(source, start) USING (source)""",
        "fx_a",
        "fx_b",
        "fx_c",
    ),
)
def heads_export(spark, sf):
    return H.heads_manifest(H.fit_ridge_heads(all_sources(spark, sf), size=16), DIMS)


@query(
    "fold_transform",
    with_ctes(
        f"""WITH f AS (SELECT *, {fx.SQL_VEC_NO} % 23 % 5 AS fold FROM fx_a),
            m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM (
                SELECT unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) AS i FROM f WHERE fold <> 0) GROUP BY i)
        SELECT name, fold, i::INTEGER - 1 AS dim, {sql_r6('((v - mean) / CASE WHEN std > 0 THEN std ELSE 1 END)::FLOAT::DOUBLE')} AS v
        FROM (SELECT name, fold, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) AS i FROM f) JOIN m USING (i)""",
        "fx_a",
    ),
)
def fold_transform(spark, sf):
    d = fx.patches(spark, sf).withColumn("fold", fx.vec_no() % 23 % 5)
    out = EN.fold_transform(d, "standard", F.col("fold") != 0)
    return out.select("name", "fold", F.posexplode("x").alias("dim", "v")).withColumn(
        "v", fx.r6(F.col("v").cast("double"))
    )


# --- evaluation ---------------------------------------------------------------------------------


def runs(spark, sf) -> DataFrame:
    """Scored rows of three configurations and five folds; fold 0 lacks class 9."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    raw = [
        (1 + (o * (c + 3) + p * (c * c + 1)) % 101 + F.when(F.col("y") == c, 60).otherwise(0)).cast("double")
        for c in range(N)
    ]
    return (
        fx.table(spark, sf, "lineitem")
        .withColumn("y", (p % 10).cast("int"))
        .withColumn("fold", F.col("l_linenumber") % 5)
        .where(~((F.col("fold") == 0) & (F.col("y") == 9)))
        .select(
            F.concat(F.lit("cfg"), (F.col("l_suppkey") % 3).cast("string")).alias("config_id"),
            "fold",
            "y",
            F.array(*raw).alias("r"),
        )
        .withColumn("proba", H.renormalize(F.col("r")))
        .drop("r")
    )


_RAW = ", ".join(
    f"(1 + (l_orderkey * {c + 3} + l_partkey * {c * c + 1}) % 101 + CASE WHEN l_partkey % 10 = {c} THEN 60 ELSE 0 END)::DOUBLE"
    for c in range(N)
)
cte(
    "fx_runs",
    f"""SELECT config_id, fold, y, list_transform(r, lambda v: v / list_sum(r)) AS proba,
        (list_position(r, list_max(r)) - 1)::INTEGER AS pred FROM (
        SELECT 'cfg' || (l_suppkey % 3) AS config_id, l_linenumber % 5 AS fold, (l_partkey % 10)::INTEGER AS y, [{_RAW}] AS r FROM lineitem)
    WHERE NOT (fold = 0 AND y = 9)""",
)
cte("fx_confusion", "SELECT config_id, fold, y, pred, count(*) AS n FROM fx_runs GROUP BY ALL", "fx_runs")
cte(
    "fx_class_table",
    """SELECT config_id, fold, cls, coalesce(sum(n) FILTER (y = cls AND pred = cls), 0)::DOUBLE AS tp,
        coalesce(sum(n) FILTER (y = cls), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (pred = cls), 0)::DOUBLE AS p, sum(n)::DOUBLE AS t
    FROM fx_confusion, (SELECT unnest(range(10))::INTEGER AS cls) GROUP BY config_id, fold, cls""",
    "fx_confusion",
)
cte(
    "fx_metrics",
    """SELECT config_id, fold, (sum(tp) * max(t) - sum(s * p)) / sqrt((max(t) * max(t) - sum(p * p)) * (max(t) * max(t) - sum(s * s))) AS mcc,
        avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END) FILTER (s + p > 0) AS recall,
        avg(2 * tp / (s + p)) FILTER (s + p > 0) AS f1, sum(tp) / max(t) AS accuracy
    FROM fx_class_table GROUP BY config_id, fold""",
    "fx_class_table",
)


def run_confusion(spark, sf) -> DataFrame:
    return E.confusion(runs(spark, sf).withColumn("pred", E.argmax("proba")))


@query("confusion", with_ctes("SELECT * FROM fx_confusion", "fx_confusion"))
def confusion(spark, sf):
    return run_confusion(spark, sf)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, fx.r6(c))
    return df


_M = ("mcc", "recall", "f1", "accuracy")


@query(
    "metrics_multiclass",
    with_ctes(
        f"SELECT config_id, fold, {', '.join(f'{sql_r6(m)} AS {m}' for m in _M)} FROM fx_metrics", "fx_metrics"
    ),
)
def metrics_multiclass(spark, sf):
    return _rounded(E.metrics_multiclass(run_confusion(spark, sf)), *_M)


@query(
    "per_class_f1",
    with_ctes(
        f"""SELECT config_id, fold, cls, {sql_r6('CASE WHEN s + p > 0 THEN 2 * tp / (s + p) ELSE 0 END')} AS f1
        FROM fx_class_table""",
        "fx_class_table",
    ),
)
def per_class_f1(spark, sf):
    return _rounded(E.per_class_f1(run_confusion(spark, sf)), "f1")


@query(
    "weighted_specificity",
    with_ctes(
        f"""SELECT config_id, fold, {sql_r6('sum((t - s - p + tp) / greatest(t - s, 1) * s) / sum(s)')} AS specificity
        FROM fx_class_table GROUP BY config_id, fold""",
        "fx_class_table",
    ),
)
def weighted_specificity(spark, sf):
    return _rounded(E.weighted_specificity(run_confusion(spark, sf)), "specificity")


cte(
    "fx_auroc",
    """WITH l AS (SELECT config_id, fold, y, unnest(proba) AS s, generate_subscripts(proba, 1) - 1 AS cls FROM fx_runs),
        g AS (SELECT config_id, fold, cls, s, count(*) FILTER (y = cls) AS pos, count(*) FILTER (y <> cls) AS neg FROM l GROUP BY ALL),
        r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY config_id, fold, cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
        a AS (SELECT config_id, fold, cls, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(pos * (below + neg / 2.0::DOUBLE)) AS wins FROM r GROUP BY ALL)
    SELECT config_id, fold, sum(wins / n) / sum(p) AS auroc FROM a WHERE p > 0 AND n > 0 GROUP BY config_id, fold""",
    "fx_runs",
)


@query(
    "weighted_auroc",
    with_ctes(f"SELECT config_id, fold, {sql_r6('auroc')} AS auroc FROM fx_auroc", "fx_auroc"),
)
def weighted_auroc(spark, sf):
    return _rounded(E.weighted_auroc(runs(spark, sf)), "auroc")


@query(
    "fold_summary",
    with_ctes(
        f"""SELECT config_id, count(*) AS n_folds, {', '.join(f"{sql_r6(f'avg({m})')} AS {m}_mean, {sql_r6(f'stddev_pop({m})')} AS {m}_std" for m in _M)}
        FROM fx_metrics GROUP BY config_id""",
        "fx_metrics",
    ),
)
def fold_summary(spark, sf):
    out = E.fold_summary(E.metrics_multiclass(run_confusion(spark, sf)), _M)
    return _rounded(out, *[f"{m}_{s}" for m in _M for s in ("mean", "std")])


@query(
    "score_and_evaluate",
    with_ctes(
        f"""WITH d AS (SELECT name, arg_min(cls, -q * 1e9 + cls * 1e-9) AS pred FROM (
                SELECT name, cls, p / ({THRESHOLDS})[cls + 1]::DOUBLE AS q FROM fx_ensemble) GROUP BY name),
            c AS (SELECT label::INTEGER AS y, pred, count(*) AS n FROM d JOIN fx_aligned USING (name) GROUP BY ALL),
            k AS (SELECT cls, coalesce(sum(n) FILTER (y = cls AND pred = cls), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (y = cls), 0)::DOUBLE AS s,
                coalesce(sum(n) FILTER (pred = cls), 0)::DOUBLE AS p, sum(n)::DOUBLE AS t
                FROM c, (SELECT unnest(range(10)) AS cls) GROUP BY cls)
        SELECT 'fixed' AS config_id, 0 AS fold,
            {sql_r6('CASE WHEN max(t) * max(t) > sum(p * p) THEN (sum(tp) * max(t) - sum(s * p)) / sqrt((max(t) * max(t) - sum(p * p)) * (max(t) * max(t) - sum(s * s))) ELSE 0 END')} AS mcc,
            {sql_r6('avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END) FILTER (s + p > 0)')} AS recall,
            {sql_r6('avg(2 * tp / (s + p)) FILTER (s + p > 0)')} AS f1, {sql_r6('sum(tp) / max(t)')} AS accuracy FROM k""",
        "fx_ensemble",
        "fx_aligned",
    ),
)
def score_and_evaluate(spark, sf):
    """Align three sources, score a head ensemble, decide by thresholds, report metrics."""
    decided = scored(spark, sf).select(
        F.lit("fixed").alias("config_id"),
        F.lit(0).alias("fold"),
        "y",
        E.argmax(H.apply_thresholds("proba", THRESHOLDS)).alias("pred"),
    )
    return _rounded(E.metrics_multiclass(E.confusion(decided)), *_M)


# --- registries ------------------------------------------------------------------------------------


@query(
    "surrogate_keys",
    with_ctes(
        f"""WITH k AS (SELECT DISTINCT specimen || ':' || patch_uid AS patch_key, image_id % 3 = 0 AS old FROM fx_ext),
            d AS (SELECT patch_key, row_number() OVER (ORDER BY {sql_u('id', 'patch_key')}, patch_key) AS patch_id FROM k WHERE old),
            n AS (SELECT patch_key, (SELECT max(patch_id) FROM d) + row_number() OVER (ORDER BY {sql_u('id', 'patch_key')}, patch_key) AS patch_id
                FROM k WHERE NOT old)
        SELECT * FROM d UNION ALL SELECT * FROM n""",
        "fx_ext",
    ),
)
def surrogate_keys(spark, sf):
    from tilewright.session import materialize

    keys = ext_table(spark, sf, F.concat_ws(":", "specimen", "patch_uid").alias("patch_key"), "image_id")
    first = materialize(
        R.surrogate_keys(keys.where("image_id % 3 = 0"), None, "patch_key", "patch_id"), "patch-ids"
    )
    return R.surrogate_keys(keys, first, "patch_key", "patch_id")


def _reg(df: DataFrame) -> DataFrame:
    return df.select(F.lit("m1").alias("model_key"), "patch_uid", "label")


@query(
    "registry_insert",
    with_ctes(
        """SELECT 'm1' AS model_key, patch_uid, label FROM fx_ext WHERE image_id % 3 <> 2""",
        "fx_ext",
    ),
)
def registry_insert(spark, sf):
    e = ext_table(spark, sf)
    return R.registry_insert(
        _reg(e.where("image_id % 3 = 0")), _reg(e.where("image_id % 3 = 1")), ["model_key", "patch_uid"]
    )


@query(
    "registry_conflicts",
    with_ctes(
        """WITH r AS (SELECT patch_uid FROM fx_ext WHERE image_id % 3 = 0),
            b AS (SELECT patch_uid FROM fx_ext_all WHERE image_id % 2 = 0)
        SELECT patch_uid, count(*) > 1 AS repeated, patch_uid IN (SELECT patch_uid FROM r) AS registered FROM b GROUP BY patch_uid
        HAVING count(*) > 1 OR patch_uid IN (SELECT patch_uid FROM r)""",
        "fx_ext",
    ),
)
def registry_conflicts(spark, sf):
    return R.registry_conflicts(
        ext(spark, sf).where("image_id % 3 = 0"),
        ext_all(spark, sf).where("image_id % 2 = 0"),
        ["patch_uid"],
    )


def _experiments(spark, sf):
    from tilewright.plans.sampling import results

    return results(spark, sf).select("config_id", "status", "f1")


@query(
    "registry_upsert",
    """WITH r AS (SELECT printf('cfg-%06d', p_partkey) AS config_id, CASE WHEN p_partkey % 40 = 1 THEN 'failed' ELSE 'completed' END AS status,
            (p_partkey * 3 % 17) / 17.0::DOUBLE AS f1, p_partkey FROM part)
    SELECT config_id, CASE WHEN p_partkey % 4 = 1 THEN 'completed' ELSE status END AS status,
        round(CASE WHEN p_partkey % 4 = 1 THEN 0.5 ELSE f1 END, 6) AS f1 FROM r WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 1""",
)
def registry_upsert(spark, sf):
    e = _experiments(spark, sf).withColumn("k", F.substring("config_id", 5, 20).cast("int"))
    batch = e.where("k % 4 = 1").withColumn("status", F.lit("completed")).withColumn("f1", F.lit(0.5))
    out = R.registry_upsert(e.where("k % 3 <> 0").drop("k"), batch.drop("k"))
    return out.withColumn("f1", fx.r6("f1"))


@query(
    "skip_completed",
    """SELECT printf('cfg-%06d', p_partkey) AS config_id FROM part
    WHERE NOT (p_partkey % 2 = 0 OR p_partkey % 3 = 0) OR p_partkey % 40 = 1""",
)
def skip_completed(spark, sf):
    e = _experiments(spark, sf)
    k = F.substring("config_id", 5, 20).cast("int")
    return R.skip_completed(e.select("config_id"), e.where((k % 2 == 0) | (k % 3 == 0)))


@query(
    "oof_store",
    with_ctes(
        f"""WITH f AS (SELECT name, label, {fx.SQL_VEC_NO} AS patch_id, {fx.SQL_VEC_NO} % 23 AS patient_id FROM fx_aligned)
        SELECT 'fixed' AS config_id, patch_id, patient_id, (patient_id % 5)::INTEGER AS fold, label::INTEGER AS y, cls,
            {sql_r6('p')} AS p FROM f JOIN fx_ensemble USING (name) WHERE patient_id NOT IN (7, 13)""",
        "fx_ensemble",
        "fx_aligned",
    ),
)
def oof_store(spark, sf):
    pid = fx.vec_no() % 23
    rows = scored(spark, sf).select(
        F.lit("fixed").alias("config_id"),
        fx.vec_no().alias("patch_id"),
        pid.alias("patient_id"),
        F.when(pid.isin(7, 13), -1).otherwise(pid % 5).cast("int").alias("fold"),
        "y",
        "proba",
    )
    return _long(R.oof_store(rows), "proba", "config_id", "patch_id", "patient_id", "fold", "y")
