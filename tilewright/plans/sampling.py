"""Queries: sampling, quotas, ranking, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import aggregate as A
from tilewright.operators import sample as S
from tilewright.operators import setops as SO
from tilewright.operators.evaluate import rank_configs as rank_op
from tilewright.operators.folds import group_kfold as kfold_op
from tilewright.plans import fixtures as fx
from tilewright.plans.curate import ext, ext_table, sections
from tilewright.plans.fixtures import cte, sql_hash32, sql_r6, sql_u, with_ctes
from tilewright.plans.registry import query
from tilewright.schema import EXTERNAL_CLASSES, class_table

QUOTA = 400


def _low(by: str, n, key: str = "patch_uid", seed=42, table: str = "fx_ext") -> str:
    return f"""SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {by}
        ORDER BY {sql_u(seed, key)}, {key}) <= {n}"""


cte(
    "fx_round_robin",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, specimen
            ORDER BY {sql_u(42, 'patch_uid')}, patch_uid) AS round FROM fx_ext)
        QUALIFY row_number() OVER (PARTITION BY label
            ORDER BY round, {sql_u('42-specimen', 'specimen')}, specimen) <= {QUOTA}""",
    "fx_ext",
)


@query(
    "round_robin_select",
    with_ctes("SELECT patch_uid, label, specimen, round FROM fx_round_robin", "fx_round_robin"),
)
def round_robin_select(spark, sf):
    return S.round_robin_select(ext_table(spark, sf, "patch_uid", "label", "specimen"), QUOTA).select("patch_uid", "label", "specimen", "round")


@query(
    "round_robin_report",
    with_ctes(
        """SELECT e.label, n_specimens, coalesce(n_touched, 0) AS n_touched, coalesce(n_selected, 0) AS n_selected
        FROM (SELECT label, count(DISTINCT specimen) AS n_specimens FROM fx_ext GROUP BY label) e
        LEFT JOIN (SELECT label, count(DISTINCT specimen) AS n_touched, count(*) AS n_selected
            FROM fx_round_robin GROUP BY label) s ON e.label = s.label""",
        "fx_round_robin",
    ),
)
def round_robin_report(spark, sf):
    e = ext_table(spark, sf, "patch_uid", "label", "specimen")
    return S.round_robin_report(e, S.round_robin_select(e, QUOTA))


@query(
    "reservoir_per_class",
    with_ctes(f"SELECT patch_uid, label FROM ({_low('label', 300, seed=7)})", "fx_ext"),
)
def reservoir_per_class(spark, sf):
    return S.reservoir_per_class(ext_table(spark, sf), 300, seed=7).select("patch_uid", "label")


def _have(spark, sf):
    """Already embedded rows per class, zeros included."""
    return A.class_counts(ext_table(spark, sf, "label", "image_id").where("image_id % 8 = 0"), class_table(spark, EXTERNAL_CLASSES))


cte(
    "fx_have",
    """SELECT c.label, c.label_int::INTEGER AS label_int, count(e.label) AS n
    FROM (VALUES ('CT', 0), ('IC', 2), ('MP', 4), ('NC', 5), ('PN', 7)) AS c(label, label_int)
    LEFT JOIN (SELECT label FROM fx_ext WHERE image_id % 8 = 0) e ON c.label = e.label GROUP BY ALL""",
    "fx_ext",
)


@query(
    "quota_plan",
    with_ctes(
        """SELECT label, label_int, n, need::BIGINT AS need, (CASE WHEN need <= 0 THEN 0 ELSE
            need + greatest(4, ceil(need * 0.03::DOUBLE)) END)::BIGINT AS capacity, mode FROM (
            SELECT *, greatest(1500 - n, 0) AS need, 'target' AS mode FROM fx_have
            UNION ALL SELECT *, 500, 'add' FROM fx_have)""",
        "fx_have",
    ),
)
def quota_plan(spark, sf):
    have = _have(spark, sf)
    return (
        S.quota_plan(have, target=1500)
        .withColumn("mode", F.lit("target"))
        .unionByName(S.quota_plan(have, add=500).withColumn("mode", F.lit("add")))
    )


@query(
    "interleave_by_class",
    with_ctes(
        f"""SELECT patch_uid, label, round, row_number() OVER (ORDER BY round,
                list_position(['CT','IC','MP','NC','PN'], label)) AS position FROM (
            SELECT patch_uid, label, row_number() OVER (PARTITION BY label
                ORDER BY {sql_u(42, 'patch_uid')}, patch_uid) AS round FROM fx_ext)""",
        "fx_ext",
    ),
)
def interleave_by_class(spark, sf):
    out = S.interleave_by_class(ext_table(spark, sf, "patch_uid", "label"), class_table(spark, EXTERNAL_CLASSES))
    return out.select("patch_uid", "label", "round", "position")


def arrivals(spark, sf):
    """Decoded patches in arrival order; every 37th failed to decode."""
    f = fx.feed(spark, sf)
    return f.select(
        F.col("event_id").alias("pos"), "patch_uid", F.col("cls").alias("label"), (F.col("event_id") % 37 == 0).alias("failed")
    )


def _quota(spark, sf):
    n = fx.feed(spark, sf).groupBy(F.col("cls").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", F.floor(F.col("n") / 3).cast("long").alias("k"))


@query(
    "exact_quota",
    with_ctes(
        """SELECT event_id AS pos, patch_uid, cls AS label FROM fx_feed JOIN (
            SELECT cls, count(*) // 3 AS k FROM fx_feed GROUP BY cls) q USING (cls) WHERE event_id % 37 <> 0
        QUALIFY row_number() OVER (PARTITION BY cls ORDER BY event_id) <= k""",
        "fx_feed",
    ),
)
def exact_quota(spark, sf):
    return S.exact_quota(arrivals(spark, sf), _quota(spark, sf), "pos", span=512).select("pos", "patch_uid", "label")


@query(
    "cap_per_class",
    with_ctes(f"SELECT name, label, patient FROM ({_low('label', 46, 'name', table='fx_a')})", "fx_a"),
)
def cap_per_class(spark, sf):
    return S.cap_per_class(fx.patches(spark, sf), 46).select("name", "label", "patient")


@query(
    "select_exact_per_class",
    with_ctes(
        f"""SELECT patch_uid, label, {sql_r6(sql_u('10042-order', 'patch_uid'))} AS shuffle_u
        FROM ({_low('label', 200, seed=10042)})""",
        "fx_ext",
    ),
)
def select_exact_per_class(spark, sf):
    out = S.select_exact_per_class(
        ext_table(spark, sf), 200, class_table(spark, EXTERNAL_CLASSES), seed=42, source_offset=10_000
    )
    return out.select("patch_uid", "label", fx.r6("shuffle_u").alias("shuffle_u"))


@query(
    "cap_rows",
    with_ctes(
        f"""SELECT foundation, patient, slide, name FROM ({_low('foundation', 150, 'name',
            table='(SELECT foundation, patient, slide, name FROM fx_a UNION ALL SELECT foundation, patient, slide, name FROM fx_b)')})""",
        "fx_a",
        "fx_b",
    ),
)
def cap_rows(spark, sf):
    both = fx.patches(spark, sf, "a").unionByName(fx.patches(spark, sf, "b"))
    return S.cap_rows(both, 150).select("foundation", "patient", "slide", "name")


@query(
    "per_specimen_cap",
    with_ctes(f"SELECT patch_uid, specimen, label FROM ({_low('specimen, label', 3)})", "fx_ext"),
)
def per_specimen_cap(spark, sf):
    return S.per_specimen_cap(ext(spark, sf), 3).select("patch_uid", "specimen", "label")


@query(
    "sample_per_slide",
    with_ctes(
        f"""WITH s AS (SELECT slide FROM (SELECT DISTINCT slide FROM fx_a)
            ORDER BY {sql_u('42-slide', 'slide')}, slide LIMIT 60)
        SELECT slide, name FROM ({_low('slide', 4, 'name', table='(SELECT * FROM fx_a WHERE slide IN (SELECT slide FROM s))')})""",
        "fx_a",
    ),
)
def sample_per_slide(spark, sf):
    return S.sample_per_slide(fx.patches(spark, sf), 4, max_slides=60).select("slide", "name")


cte(
    "fx_sections",
    """SELECT 'S' || (p_partkey % 40) AS specimen, p_partkey AS image_id,
        (p_size % 9 * 512 + 100)::INTEGER AS width, (p_partkey % 5 * 512 + 60)::INTEGER AS height FROM part""",
)
cte(
    "fx_tiles",
    """SELECT *, image_id || ':' || "left" || ':' || top AS tile FROM (
        SELECT specimen, image_id, width, height, "left", unnest(range(0, height - 511, 512))::INTEGER AS top FROM (
            SELECT specimen, image_id, width, height, unnest(range(0, width - 511, 512))::INTEGER AS "left" FROM fx_sections))""",
    "fx_sections",
)


@query(
    "tile_grid",
    with_ctes(
        """SELECT 'whole' AS variant, image_id, "left", top FROM fx_tiles
        UNION ALL SELECT 'any', image_id, "left",
            unnest(CASE WHEN height >= 512 THEN range(0, height - 511, 512) ELSE [0] END)::INTEGER FROM (
            SELECT image_id, height, unnest(CASE WHEN width >= 512 THEN range(0, width - 511, 512) ELSE [0] END)::INTEGER AS "left"
            FROM fx_sections)""",
        "fx_tiles",
    ),
)
def tile_grid(spark, sf):
    sec = sections(spark, sf)
    cols = ["variant", "image_id", "left", "top"]
    return (
        S.tile_grid(sec)
        .withColumn("variant", F.lit("whole"))
        .select(*cols)
        .unionByName(S.tile_grid(sec, variant="any").withColumn("variant", F.lit("any")).select(*cols))
    )


@query(
    "raster_level",
    with_ctes(
        """SELECT image_id, (SELECT min(d) FROM range(1, 42) t(d)
            WHERE greatest(width, height) // (2 ** d)::BIGINT <= 600)::INTEGER AS level FROM fx_sections""",
        "fx_sections",
    ),
)
def raster_level(spark, sf):
    return S.raster_level(sections(spark, sf), 1, 600).select("image_id", "level")


@query(
    "tile_cap_per_section",
    with_ctes(f'SELECT image_id, "left", top, tile FROM ({_low("image_id", 5, "tile", table="fx_tiles")})', "fx_tiles"),
)
def tile_cap_per_section(spark, sf):
    return S.tile_cap_per_section(S.tile_grid(sections(spark, sf)), 5).select("image_id", "left", "top", "tile")


@query(
    "crop_grid",
    with_ctes(
        """WITH s AS (SELECT image_id, width, height, least(512, width, height) AS c FROM fx_sections),
            p AS (SELECT * FROM (VALUES (1, 0, 1, 1), (3, 0, 1, 1), (3, 1, 0, 0), (3, 2, 2, 2), (5, 0, 1, 1), (5, 1, 0, 0),
                (5, 2, 2, 0), (5, 3, 0, 2), (5, 4, 2, 2), (9, 0, 0, 0), (9, 1, 1, 0), (9, 2, 2, 0), (9, 3, 0, 1), (9, 4, 1, 1),
                (9, 5, 2, 1), (9, 6, 0, 2), (9, 7, 1, 2), (9, 8, 2, 2)) AS v(n_crops, crop, px, py))
        SELECT image_id, n_crops, crop, x0, y0, x0 + c AS x1, y0 + c AS y1,
            n_crops > 1 AND width = c AND height = c AS collapsed FROM (
            SELECT *, ((width - c) * px // 2)::INTEGER AS x0, ((height - c) * py // 2)::INTEGER AS y0 FROM s, p)""",
        "fx_sections",
    ),
)
def crop_grid(spark, sf):
    sec = sections(spark, sf)
    out = None
    for n in (1, 3, 5, 9):
        part = S.crop_grid(sec, 512, n).select(
            "image_id", F.lit(n).alias("n_crops"), "crop", "x0", "y0", "x1", "y1", "collapsed"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "stratified_split",
    with_ctes(
        f"""SELECT patch_uid, label, CASE WHEN rn <= floor(n * 0.1::DOUBLE + 0.5) THEN 'cal' ELSE 'fit' END AS role FROM (
            SELECT patch_uid, label, count(*) OVER (PARTITION BY label) AS n,
                row_number() OVER (PARTITION BY label ORDER BY {sql_u(42, 'patch_uid')}, patch_uid) AS rn FROM fx_ext)""",
        "fx_ext",
    ),
)
def stratified_split(spark, sf):
    return S.stratified_split(ext_table(spark, sf), 0.1, key="patch_uid").select("patch_uid", "label", "role")


@query(
    "group_kfold",
    with_ctes(
        f"""WITH c AS (SELECT patient, label, count(*) AS c FROM fx_a WHERE label >= 0 GROUP BY ALL),
            g AS (SELECT patient, sum(c) AS n, arg_max(label, c * 100 - label) AS stratum FROM c GROUP BY patient),
            r AS (SELECT *, (row_number() OVER (ORDER BY stratum, n DESC, {sql_hash32('fold', 'patient')}, patient) - 1) % 10 AS step
                FROM g WHERE patient NOT IN ('patient-007', 'patient-013')),
            f AS (SELECT patient, (CASE WHEN step < 5 THEN step ELSE 9 - step END)::INTEGER AS fold FROM r
                UNION ALL SELECT patient, -1 FROM g WHERE patient IN ('patient-007', 'patient-013'))
        SELECT name, patient, label, fold FROM fx_a JOIN f USING (patient) WHERE label >= 0""",
        "fx_a",
    ),
)
def group_kfold(spark, sf):
    return kfold_op(fx.patches(spark, sf), 5, forced=("patient-007", "patient-013")).select(
        "name", "patient", "label", "fold"
    )


@query(
    "index_export_sorted",
    with_ctes('SELECT label_int, specimen, image_id, "left", top, patch_uid FROM fx_ext', "fx_ext"),
)
def index_export_sorted(spark, sf):
    return S.index_export_sorted(ext(spark, sf)).select(
        "label_int", "specimen", "image_id", "left", "top", "patch_uid"
    )


METRICS = ("f1", "mcc", "recall", "specificity", "auroc", "accuracy")


def results(spark, sf):
    """Experiment results with ties and missing metrics, one per part."""
    p = F.col("p_partkey")
    cols = [
        F.when((p % 50 == 3) & F.lit(m == "mcc"), None)
        .otherwise((p * (i + 3) % 17) / 17.0)
        .cast("double")
        .alias(m)
        for i, m in enumerate(METRICS)
    ]
    return fx.table(spark, sf, "part").select(
        F.format_string("cfg-%06d", p).alias("config_id"),
        F.when(p % 40 == 1, "failed").otherwise("completed").alias("status"),
        *cols,
    )


def _sql_results() -> str:
    cols = ", ".join(
        (f"CASE WHEN p_partkey % 50 = 3 THEN NULL ELSE " if m == "mcc" else "(")
        + f"(p_partkey * {i + 3} % 17) / 17.0::DOUBLE"
        + (f" END AS {m}" if m == "mcc" else f") AS {m}")
        for i, m in enumerate(METRICS)
    )
    return f"""SELECT printf('cfg-%06d', p_partkey) AS config_id,
        CASE WHEN p_partkey % 40 = 1 THEN 'failed' ELSE 'completed' END AS status, {cols} FROM part"""


cte("fx_results", _sql_results())


@query(
    "rank_configs",
    with_ctes(
        f"""SELECT config_id, {sql_r6('m')} AS mean_metric, row_number() OVER (ORDER BY m DESC NULLS LAST,
            f1 DESC NULLS LAST, mcc DESC NULLS LAST, recall DESC NULLS LAST, specificity DESC NULLS LAST,
            auroc DESC NULLS LAST, accuracy DESC NULLS LAST, config_id) AS rank
        FROM (SELECT *, (f1 + mcc + recall) / 3.0::DOUBLE AS m FROM fx_results WHERE status = 'completed')""",
        "fx_results",
    ),
)
def rank_configs(spark, sf):
    done = results(spark, sf).where("status = 'completed'")
    return rank_op(done).select("config_id", fx.r6("mean_metric").alias("mean_metric"), "rank")


def labelled_tiles(spark, sf):
    """Tiles with an annotation label; the label leans to the image."""
    t = S.tile_grid(sections(spark, sf))
    i = F.col("image_id")
    label = F.get(
        F.array(*[F.lit(c) for c in EXTERNAL_CLASSES]),
        F.when(F.col("left") % 1024 == 0, i % 2).otherwise((i + F.col("top") / 512) % 5).cast("int"),
    )
    return t.withColumn("label", label)


cte(
    "fx_labelled_tiles",
    """SELECT *, ['CT','IC','MP','NC','PN'][(CASE WHEN "left" % 1024 = 0 THEN image_id % 2
        ELSE (image_id + top // 512) % 5 END) + 1] AS label FROM fx_tiles""",
    "fx_tiles",
)


cte(
    "fx_probed",
    f"""SELECT * FROM fx_labelled_tiles
        QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {sql_u(42, 'tile')}, tile) <= 4""",
    "fx_labelled_tiles",
)


@query(
    "probe_gate",
    with_ctes(
        """SELECT image_id, tile, label FROM fx_labelled_tiles WHERE image_id IN
            (SELECT image_id FROM fx_probed WHERE label IN ('MP', 'PN'))""",
        "fx_probed",
    ),
)
def probe_gate(spark, sf):
    return S.probe_gate(labelled_tiles(spark, sf), 4, ("MP", "PN")).select("image_id", "tile", "label")


@query(
    "probe_report",
    with_ctes(
        """SELECT image_id, count(*) AS n_probed, count(*) FILTER (label = 'MP') AS "hits_MP",
            count(*) FILTER (label = 'PN') AS "hits_PN" FROM fx_probed GROUP BY image_id""",
        "fx_probed",
    ),
)
def probe_report(spark, sf):
    return S.probe_report(labelled_tiles(spark, sf), 4, ("MP", "PN"))


# --- set operations -------------------------------------------------------------


def _name(col: str):
    return F.format_string("W%06d", F.col(col)).alias("specimen")


@query(
    "specimen_queue",
    """WITH every AS (SELECT printf('W%06d', c_custkey) AS specimen FROM customer),
        skip AS (SELECT printf('W%06d', o_custkey) AS specimen FROM orders WHERE o_orderkey % 31 = 0
            UNION SELECT printf('W%06d', o_custkey) FROM orders WHERE o_totalprice > 400000
            UNION SELECT printf('W%06d', c_custkey) FROM customer WHERE c_nationkey = 3),
        own AS (SELECT printf('W%06d', c_custkey) AS specimen FROM customer WHERE c_nationkey = 5)
    SELECT specimen FROM every WHERE specimen NOT IN (SELECT specimen FROM skip
            WHERE specimen NOT IN ('W000031', 'W000062')) AND specimen NOT IN (SELECT specimen FROM own)
        AND specimen >= 'W000010' AND specimen NOT IN ('W000020', 'W000021')
        AND specimen IN (SELECT printf('W%06d', c_custkey) FROM customer WHERE c_acctbal > 0)""",
)
def specimen_queue(spark, sf):
    c, o = fx.table(spark, sf, "customer"), fx.table(spark, sf, "orders")
    return SO.specimen_queue(
        c.select(_name("c_custkey")),
        skip=[
            o.where("o_orderkey % 31 = 0").select(_name("o_custkey")),
            o.where("o_totalprice > 400000").select(_name("o_custkey")),
            c.where("c_nationkey = 3").select(_name("c_custkey")),
        ],
        own_completed=c.where("c_nationkey = 5").select(_name("c_custkey")),
        explicit=["W000020", "W000021"],
        allow=c.where("c_acctbal > 0").select(_name("c_custkey")),
        min_name="W000010",
        force=["W000031", "W000062"],
    )


@query(
    "resume_progress",
    with_ctes(
        """WITH m AS (SELECT * FROM fx_ext WHERE image_id % 3 <> 1),
            n AS (SELECT specimen, count(DISTINCT (image_id, "left", top)) AS n_tiles FROM m GROUP BY specimen),
            k AS (SELECT specimen, array_to_string(list_sort(list(label || '=' || n)), ';') AS class_counts FROM (
                SELECT specimen, label, count(*) AS n FROM m GROUP BY specimen, label) GROUP BY specimen),
            d AS (SELECT DISTINCT specimen, true AS completed FROM fx_ext WHERE substr(specimen, 2, 1) = '7')
        SELECT specimen, coalesce(n_tiles, 0) AS n_tiles, coalesce(class_counts, '') AS class_counts,
            coalesce(completed, false) AS completed FROM (n JOIN k USING (specimen)) FULL OUTER JOIN d USING (specimen)""",
        "fx_ext",
    ),
)
def resume_progress(spark, sf):
    e = ext_table(spark, sf)
    return SO.resume_progress(
        e.where("image_id % 3 <> 1"), e.where(F.substring("specimen", 2, 1) == "7").select("specimen")
    )


def extra_pools(spark, sf):
    n = fx.vec_no()
    a, b = fx.unlabelled(spark, sf), fx.patches(spark, sf, "b")
    return {
        "stainaug": a.where(n % 2 == 0).unionByName(b.where(n % 3 == 0)),
        "external": a.where(n % 5 == 0),
        "absent": None,
    }


cte(
    "fx_extras",
    f"""SELECT foundation, patient, slide, name, label, x, 'stainaug' AS pool FROM fx_unlabelled WHERE {fx.SQL_VEC_NO} % 2 = 0
    UNION ALL SELECT foundation, patient, slide, name, label, x, 'stainaug' FROM fx_b WHERE {fx.SQL_VEC_NO} % 3 = 0
    UNION ALL SELECT foundation, patient, slide, name, label, x, 'external' FROM fx_unlabelled WHERE {fx.SQL_VEC_NO} % 5 = 0""",
    "fx_unlabelled",
    "fx_b",
)


@query(
    "union_extras",
    with_ctes(f"SELECT foundation, name, label, pool, {fx.sql_vec('x')} AS x FROM fx_extras", "fx_extras"),
)
def union_extras(spark, sf):
    return SO.union_extras(extra_pools(spark, sf)).select(
        "foundation", "name", "label", "pool", fx.vec_text("x").alias("x")
    )


@query(
    "cap_extras",
    with_ctes(
        f"""SELECT foundation, name, pool FROM fx_extras QUALIFY row_number() OVER (PARTITION BY foundation
            ORDER BY {sql_u(42, "pool || '/' || name")}, pool || '/' || name) <= 120""",
        "fx_extras",
    ),
)
def cap_extras(spark, sf):
    return SO.cap_extras(SO.union_extras(extra_pools(spark, sf)), 120).select("foundation", "name", "pool")


@query(
    "extras_summary",
    with_ctes(
        """WITH g AS (SELECT * FROM (SELECT unnest(['stainaug', 'external', 'absent']) AS pool),
                (SELECT DISTINCT foundation FROM fx_extras)),
            n AS (SELECT pool, foundation, count(DISTINCT patient || slide) AS n_slide_files, count(*) AS n_before,
                count(*) FILTER (label >= 0) AS n_rows FROM fx_extras GROUP BY pool, foundation),
            c AS (SELECT pool, foundation, string_agg(label || '=' || n, ';' ORDER BY label) AS per_class FROM (
                SELECT pool, foundation, label, count(*) AS n FROM fx_extras WHERE label >= 0 GROUP BY ALL) GROUP BY pool, foundation)
        SELECT pool, foundation, n_before IS NOT NULL AS found, coalesce(n_slide_files, 0) AS n_slide_files,
            coalesce(n_before, 0) AS n_before, coalesce(n_rows, 0) AS n_rows, coalesce(per_class, '') AS per_class,
            coalesce(n_before, 0) - coalesce(n_rows, 0) AS n_dropped
        FROM g LEFT JOIN n USING (pool, foundation) LEFT JOIN c USING (pool, foundation)""",
        "fx_extras",
    ),
)
def extras_summary(spark, sf):
    extras = SO.union_extras(extra_pools(spark, sf))
    pools = SO.normalize_suffixes(["stainaug, external", "absent", "external"])
    expected = extras.select("foundation").distinct().withColumn(
        "pool", F.explode(F.array(*[F.lit(p) for p in pools]))
    )
    return SO.extras_summary(extras, expected)
