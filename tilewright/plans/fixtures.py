"""Pipeline-shaped views over the given tables, in Spark and as DuckDB CTEs.

Each fixture has the shape of one table of the data model (patches, parts,
files, feed, pixels, heads, ...).  The Spark builder and the CTE of the same
name evaluate the same expressions, so every query can be checked end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.schema import EXTERNAL_CLASSES

N_PATIENTS = 23
N_SLIDES = 92
CHUNK = 16


#: Tables whose rows become the large fixtures, with the key that deals them out and the rows of a partition:
#: a small file is one split of a scan. Dealing by key needs no sort, as dealing in turn does.
DEALT = {"lineitem": (("l_orderkey", "l_linenumber"), 500_000), "part": (("p_partkey",), 50_000)}
PARTS = 16


def table(
    spark: SparkSession, sf: str, name: str, keys: tuple[str, ...] | None = None, rows: int | None = None
) -> DataFrame:
    """A given table; ``DEALT`` ones in at least ``PARTS`` partitions, more as the table grows; by other ``keys`` or ``rows``, if given."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name not in DEALT:
        return df
    own_keys, own_rows = DEALT[name]
    return df.repartition(max(PARTS, -(-df.count() // (rows or own_rows))), *(keys or own_keys))


# --- rendering shared by Spark and DuckDB -----------------------------------


def vec_text(x) -> Column:
    """A vector as comma-joined integers of 1e-6 units."""
    col = x if isinstance(x, Column) else F.col(x)
    return F.array_join(
        F.transform(col, lambda v: F.round(v.cast("double") * 1e6).cast("long").cast("string")), ","
    )


def sql_vec(x: str) -> str:
    return (
        f"array_to_string(list_transform({x}, "
        f"lambda v: CAST(round(v::DOUBLE * 1e6) AS BIGINT)), ',')"
    )


def r6(c) -> Column:
    col = c if isinstance(c, Column) else F.col(c)
    return F.round(col, 6) + F.lit(0.0)


def sql_r6(e: str) -> str:
    return f"(round({e}, 6) + 0.0::DOUBLE)"


def sql_hash32(seed, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT"


def sql_u(seed, *keys: str) -> str:
    return f"({sql_hash32(seed, *keys)} / 4294967296.0::DOUBLE)"


def sql_norm(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda v: v::DOUBLE * v::DOUBLE)))"


def sql_l2(x: str) -> str:
    n = sql_norm(x)
    return f"CASE WHEN {n} > 0 THEN list_transform({x}, lambda w: (w::DOUBLE / {n})::FLOAT) ELSE {x} END"


# --- CTE assembly ------------------------------------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    _CTES[name] = (deps, sql)


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and all they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    text = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {text},\n{body[5:]}"
    return f"WITH {text}\n{body}"


# --- patch embeddings ----------------------------------------------------------

_SLICES = {"a": (1, 64, None), "b": (1, 32, 17), "c": (33, 32, 19)}


def patches(spark: SparkSession, sf: str, source: str = "a") -> DataFrame:
    """Source ``a`` has all 64 dims; ``b`` and ``c`` half of them and fewer rows."""
    start, length, gap = _SLICES[source]
    df = table(spark, sf, "embeddings")
    if gap:
        df = df.where(F.col("vec_id") % gap != 0)
    return df.select(
        F.lit(source).alias("foundation"),
        F.format_string("patient-%03d", F.col("vec_id") % N_PATIENTS).alias("patient"),
        F.format_string("slide-%04d", F.col("vec_id") % N_SLIDES).alias("slide"),
        F.concat(F.lit("val_"), F.col("vec_id").cast("string")).alias("name"),
        F.col("label").cast("short").alias("label"),
        (F.col("embedding") if length == 64 else F.slice("embedding", start, length)).alias("x"),
    )


for _s, (_a, _n, _g) in _SLICES.items():
    cte(
        f"fx_{_s}",
        f"""SELECT '{_s}' AS foundation,
            printf('patient-%03d', vec_id % {N_PATIENTS}) AS patient,
            printf('slide-%04d', vec_id % {N_SLIDES}) AS slide,
            'val_' || vec_id AS name, label::SMALLINT AS label,
            embedding[{_a}:{_a + _n - 1}] AS x
        FROM embeddings {f'WHERE vec_id % {_g} <> 0' if _g else ''}""",
    )


def vec_no(name="name") -> Column:
    return F.substring(F.col(name), 5, 20).cast("long")


SQL_VEC_NO = "substr(name, 5)::BIGINT"


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    df = patches(spark, sf)
    return df.withColumn(
        "label", F.when(vec_no() % 7 == 0, F.lit(-1)).otherwise(F.col("label")).cast("short")
    )


cte(
    "fx_unlabelled",
    f"""SELECT foundation, patient, slide, name, x,
        (CASE WHEN {SQL_VEC_NO} % 7 = 0 THEN -1 ELSE label END)::SMALLINT AS label FROM fx_a""",
    "fx_a",
)


def bad_vectors(spark: SparkSession, sf: str, modulo: int = 50) -> DataFrame:
    """NaN in the first dim for id % modulo = 0, infinity for id % modulo = 1."""
    hit = vec_no() % modulo
    first = (
        F.when(hit == 0, F.lit(float("nan")))
        .when(hit == 1, F.lit(float("inf")))
        .otherwise(F.col("x")[0])
        .cast("float")
    )
    return patches(spark, sf).withColumn("x", F.concat(F.array(first), F.slice("x", 2, 63)))


for _m in (50, 12):
    cte(
        f"fx_bad{_m}",
        f"""SELECT foundation, patient, slide, name, label,
            list_concat([(CASE WHEN {SQL_VEC_NO} % {_m} = 0 THEN 'nan'::FLOAT
                WHEN {SQL_VEC_NO} % {_m} = 1 THEN 'inf'::FLOAT ELSE x[1] END)::FLOAT], x[2:64]) AS x
        FROM fx_a""",
        "fx_a",
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Block files with re-run duplicates: a later part repeats every fifth patch
    with the vector negated, and one unfinished part repeats every tenth."""
    a = patches(spark, sf)
    n = vec_no()

    def part(df, path, x, done):
        return df.withColumn("x", x).withColumn("part_path", path).withColumn(
            "pos", n
        ).withColumn("done", F.lit(done))

    first = part(a, F.format_string("unit-%04d/block-000000", n % 4), F.col("x"), True)
    rerun = part(
        a.where(n % 5 == 0), F.lit("unit-0004/block-000001"), F.transform("x", lambda v: -v), True
    )
    broken = part(
        a.where(n % 10 == 0),
        F.lit("unit-0005/block-000000"),
        F.transform("x", lambda v: (v * F.lit(0.5)).cast("float")),
        False,
    )
    return first.unionByName(rerun).unionByName(broken)


cte(
    "fx_parts",
    f"""SELECT *, printf('unit-%04d/block-000000', {SQL_VEC_NO} % 4) AS part_path,
            {SQL_VEC_NO} AS pos, true AS done FROM fx_a
        UNION ALL SELECT foundation, patient, slide, name, label, list_transform(x, lambda v: -v),
            'unit-0004/block-000001', {SQL_VEC_NO}, true FROM fx_a WHERE {SQL_VEC_NO} % 5 = 0
        UNION ALL SELECT foundation, patient, slide, name, label,
            list_transform(x, lambda v: (v * 0.5)::FLOAT),
            'unit-0005/block-000000', {SQL_VEC_NO}, false FROM fx_a WHERE {SQL_VEC_NO} % 10 = 0""",
    "fx_a",
)


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return (
        table(spark, sf, "embeddings")
        .where(v % 11 != 0)
        .select(
            F.concat(F.lit("val_"), v.cast("string")).alias("Name"),
            (v % N_PATIENTS).cast("int").alias("Patient"),
            (v % N_SLIDES).cast("int").alias("Slide"),
        )
    )


cte(
    "fx_mapping",
    f"""SELECT 'val_' || vec_id AS "Name", (vec_id % {N_PATIENTS})::INTEGER AS "Patient",
        (vec_id % {N_SLIDES})::INTEGER AS "Slide" FROM embeddings WHERE vec_id % 11 <> 0""",
)


def views(spark: SparkSession, sf: str, suffix: str = "stainaug", every: int = 1) -> DataFrame:
    """Augmented rows ``key#augJ``, J in 0..2, with one coordinate's sign flipped."""
    base = patches(spark, sf).where(vec_no() % every == 0)
    j = F.col("j")
    return (
        base.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(3)])))
        .withColumn("x", F.transform("x", lambda v, i: F.when(i == j, -v).otherwise(v)))
        .withColumn("name", F.concat(F.col("name"), F.lit("#aug"), j.cast("string")))
        .withColumn("suffix", F.lit(suffix))
        .drop("j")
    )


cte(
    "fx_views",
    """SELECT foundation, patient, slide, name || '#aug' || j AS name, label,
        list_transform(x, lambda v, i: CASE WHEN i = j + 1 THEN -v ELSE v END) AS x,
        'stainaug' AS suffix
    FROM fx_a, (SELECT unnest([0, 1, 2]) AS j)""",
    "fx_a",
)

# --- external patch files ------------------------------------------------------


#: Rows of a partition for plans that sort whole listings inside of their partitions.
HOME_ROWS = 200_000


def files(spark: SparkSession, sf: str, home: bool = False) -> DataFrame:
    """Patch image files as a directory listing: one row per file.

    With ``home`` the image of the file as well, and all files of an image in one partition.
    """
    li = table(spark, sf, "lineitem", ("l_orderkey",), HOME_ROWS) if home else table(spark, sf, "lineitem")
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    label = F.get(F.array(*[F.lit(c) for c in EXTERNAL_CLASSES]), (p % 5).cast("int"))
    label = (
        F.when(p % 97 == 0, F.lit("XX")).when(p % 13 == 0, F.lower(label)).otherwise(label)
    )
    suffix = F.get(F.array(F.lit("png"), F.lit("jpg"), F.lit("jpeg")), (p % 3).cast("int"))
    good = F.format_string(
        "W%d_%d_%d_%d_%d_d0_%s.%s", F.col("l_suppkey"), p % 7, o, (p % 64) * 512, n * 512, label, suffix
    )
    name = F.when(p % 100 == 0, F.format_string("thumb_%d.png", o)).otherwise(good)
    base = li.select(
        *([o.alias("home")] if home else []),
        F.when(o % 2 == 0, F.lit("dir_a")).otherwise(F.lit("dir_b")).alias("source_dir"),
        name.alias("filename"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + n).alias("mtime_s"),
        F.when(p % 50 == 1, F.lit(0))
        .otherwise(F.floor("l_extendedprice"))
        .cast("long")
        .alias("size_bytes"),
        (p % 10 == 0).alias("again"),
    )
    dirs = F.when(F.col("again"), F.array(F.col("source_dir"), F.lit("dir_c"))).otherwise(
        F.array(F.col("source_dir"))
    )
    return (
        base.withColumn("source_dir", F.explode(dirs))
        .withColumn("relpath", F.concat_ws("/", "source_dir", "filename"))
        .drop("again")
    )


cte(
    "fx_files",
    """SELECT source_dir, source_dir || '/' || filename AS relpath, filename, mtime_s, size_bytes FROM (
        SELECT unnest(CASE WHEN l_partkey % 10 = 0
                THEN [CASE WHEN l_orderkey % 2 = 0 THEN 'dir_a' ELSE 'dir_b' END, 'dir_c']
                ELSE [CASE WHEN l_orderkey % 2 = 0 THEN 'dir_a' ELSE 'dir_b' END] END) AS source_dir,
            CASE WHEN l_partkey % 100 = 0 THEN 'thumb_' || l_orderkey || '.png'
            ELSE 'W' || l_suppkey || '_' || (l_partkey % 7) || '_' || l_orderkey || '_' ||
                ((l_partkey % 64) * 512) || '_' || (l_linenumber * 512) || '_d0_' ||
                (CASE WHEN l_partkey % 97 = 0 THEN 'XX'
                    WHEN l_partkey % 13 = 0 THEN lower(['CT','IC','MP','NC','PN'][l_partkey % 5 + 1])
                    ELSE ['CT','IC','MP','NC','PN'][l_partkey % 5 + 1] END) || '.' ||
                ['png','jpg','jpeg'][l_partkey % 3 + 1] END AS filename,
            (epoch_us(l_shipdate) // 1000000)::BIGINT + l_linenumber AS mtime_s,
            (CASE WHEN l_partkey % 50 = 1 THEN 0 ELSE floor(l_extendedprice) END)::BIGINT AS size_bytes
        FROM lineitem)""",
)

_SQL_NAME = (
    r"'(?i)^(.+)_(\d+)_(\d+)_(\d+)_d(\d+)_([A-Za-z0-9]+)\.(png|jpg|jpeg)$'"
)
cte(
    "fx_ext_all",
    f"""SELECT source_dir, relpath, filename, mtime_s, size_bytes,
        m.specimen AS specimen, m.image_id::BIGINT AS image_id, m.l::BIGINT AS "left",
        m.t::BIGINT AS top, m.d::SMALLINT AS downsample, upper(m.lab) AS label,
        (list_position(['CT','DM','IC','LI','MP','NC','PL','PN','WM','NOTA'], upper(m.lab)) - 1)::SMALLINT
            AS label_int,
        'ivy-gap::' || m.specimen || '::' || m.image_id || '::' || m.l || '::' || m.t || '::d' || m.d
            AS patch_uid
    FROM (SELECT *, regexp_extract(filename, {_SQL_NAME},
            ['specimen','image_id','l','t','d','lab','suf']) AS m
        FROM fx_files WHERE regexp_matches(filename, {_SQL_NAME}))
    WHERE upper(m.lab) IN ('CT','DM','IC','LI','MP','NC','PL','PN','WM','NOTA')""",
    "fx_files",
)
cte(
    "fx_ext",
    """SELECT * FROM fx_ext_all QUALIFY row_number() OVER (
        PARTITION BY patch_uid ORDER BY source_dir, filename, mtime_s, size_bytes) = 1""",
    "fx_ext_all",
)



def all_pairs(spark: SparkSession, foundations: list[str], suffixes: list[str]) -> DataFrame:
    """The expected (foundation, suffix) grid of a run."""
    pairs = [F.struct(F.lit(f).alias("foundation"), F.lit(s).alias("suffix")) for f in foundations for s in suffixes]
    return spark.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


# --- live feed ------------------------------------------------------------------

FEED_CLASSES = {"click": "CT", "view": "IC", "purchase": "MP", "signup": "NC", "error": "PN"}


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Files appearing in a live directory; every 20th uid arrives a second time."""
    e = F.col("event_id")
    uid = F.when(e % 20 == 19, e - 1).otherwise(e)
    cls = F.lit(None).cast("string")
    for event, c in FEED_CLASSES.items():
        cls = F.when(F.col("event_type") == event, F.lit(c)).otherwise(cls)
    return table(spark, sf, "events").select(
        e.alias("event_id"),
        F.concat(F.lit("tile_"), e.cast("string"), F.lit(".png")).alias("path"),
        F.concat(F.lit("uid-"), uid.cast("string")).alias("patch_uid"),
        cls.alias("cls"),
        F.col("ts").cast("timestamp").alias("mtime"),
        F.when(e % 33 == 5, F.lit(0)).otherwise(F.floor(F.col("value") * 100)).cast("long").alias("size"),
    )


cte(
    "fx_feed",
    """SELECT event_id, 'tile_' || event_id || '.png' AS path,
        'uid-' || (CASE WHEN event_id % 20 = 19 THEN event_id - 1 ELSE event_id END) AS patch_uid,
        CASE event_type WHEN 'click' THEN 'CT' WHEN 'view' THEN 'IC' WHEN 'purchase' THEN 'MP'
            WHEN 'signup' THEN 'NC' WHEN 'error' THEN 'PN' END AS cls,
        ts AS mtime,
        (CASE WHEN event_id % 33 = 5 THEN 0 ELSE floor(value * 100) END)::BIGINT AS size
    FROM events""",
)
