"""Queries: sources, sinks and streams, over files that Spark derives from the tables."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import embed as EM
from tilewright.operators import evaluate as E
from tilewright.operators import sample as S
from tilewright.plans import fixtures as fx
from tilewright.plans.fixtures import cte, sql_hash32, with_ctes
from tilewright.plans.curate import selection
from tilewright.plans.learning import scored
from tilewright.plans.pixel import image_bytes
from tilewright.plans.registry import query
from tilewright.session import scratch_path
from tilewright.sources import npz as NZ
from tilewright.sources import tables as TB
from tilewright.sources import tarshards as TS
from tilewright.sources.files import make_dirs, publish
from tilewright.streaming import ingest as ST
from tilewright.streaming.keys import register

SHARDS = 8

# --- files derived from the tables ---------------------------------------------------------


def _publish(path: str, data: bytes) -> None:
    publish(path, data, TaskContext.get().taskAttemptId())


def png(w: int, h: int, rgb: bytes) -> bytes:
    """A minimal RGB PNG."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    lines = b"".join(b"\0" + rgb[y * w * 3 : (y + 1) * w * 3] for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def labelled_images(spark, sf, where="true"):
    """Tiles, of the keys ``where``, with a shard and a label; every seventh tile has no label file."""
    n = F.substring("key", 6, 20).cast("long")
    return image_bytes(spark, sf, where).select(
        "key",
        "w",
        "h",
        "rgb",
        (n % SHARDS).cast("int").alias("shard_no"),
        F.when(n % 7 == 0, -1).otherwise(n % 10).cast("int").alias("label"),
        n.alias("n"),
    )


def tar_samples(spark, sf, where="true"):
    """The labelled tiles, of the keys ``where``, as PNG samples of their shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [png(w, h, rgb) for w, h, rgb in zip(pdf["w"], pdf["h"], pdf["rgb"])]
            yield pdf.assign(ext="png", bytes=data)[["shard", "key", "ext", "bytes", "label", "n"]]

    rows = labelled_images(spark, sf, where).withColumn("shard", F.format_string("shard-%04d.tar", "shard_no"))
    return rows.drop("shard_no").mapInPandas(run, "shard string, key string, ext string, bytes binary, label int, n long")


def tar_folder(spark, sf) -> str:
    """The samples written by the shard sink."""
    root = scratch_path(spark, "shards")
    TS.write_tar_shards(tar_samples(spark, sf), root, order="n")
    return root


cte(
    "fx_tar",
    f"""SELECT printf('shard-%04d.tar', n % {SHARDS}) AS shard, row_number() OVER (PARTITION BY n % {SHARDS} ORDER BY n) - 1 AS pos,
        'tile_' || n AS key, 'png' AS ext, (CASE WHEN n % 7 = 0 THEN -1 ELSE n % 10 END)::INTEGER AS label
    FROM (SELECT p_partkey AS n FROM part)""",
)


@query("scan_tar_shards", with_ctes("SELECT shard, pos, key, ext, label FROM fx_tar", "fx_tar"))
def scan_tar_shards(spark, sf):
    return TS.scan_tar_shards(spark, f"{tar_folder(spark, sf)}/*.tar").select("shard", "pos", "key", "ext", "label")


@query(
    "scan_tar_ranges",
    with_ctes(
        "SELECT shard, pos, key, ext, label FROM fx_tar WHERE shard <> 'shard-0003.tar' AND pos BETWEEN 2 AND 40", "fx_tar"
    ),
)
def scan_tar_ranges(spark, sf):
    """Indexed shards in byte ranges; the conditions are tested in the source."""
    pattern = f"{tar_folder(spark, sf)}/*.tar"
    TS.write_indexes(spark, pattern)
    where = [("shard", "!=", "shard-0003.tar"), ("pos", ">=", 2), ("pos", "<=", 40)]
    return TS.scan_tar_shards(spark, pattern, where=where, split_bytes=256 << 10).select("shard", "pos", "key", "ext", "label")


@query(
    "fetch_targets",
    with_ctes("SELECT shard, pos, key, ext, label FROM fx_tar WHERE label IN (1, 4) OR key LIKE '%7'", "fx_tar"),
)
def fetch_targets(spark, sf):
    """Planned keys meet the members' places; only their images are read."""
    targets = labelled_images(spark, sf).where("label IN (1, 4) OR key LIKE '%7'").select("key")
    rows = TS.fetch_targets(spark, f"{tar_folder(spark, sf)}/*.tar", targets)
    return rows.where("length(bytes) > 0").select("shard", "pos", "key", "ext", "label")


@query("stream_shards", with_ctes("SELECT shard, pos, key, ext, label FROM fx_tar", "fx_tar"))
def stream_shards(spark, sf):
    """Half of the shards, then the others after a restart: each once."""
    root, out = scratch_path(spark, "live-shards"), scratch_path(spark, "stream-shards")
    for later in (False, True):
        # Spark moves no condition below a Python stage: on the keys, it spares making every tile twice
        half = (F.substring("key", 6, 20).cast("long") % SHARDS >= SHARDS // 2) == later
        TS.write_tar_shards(tar_samples(spark, sf, half), root, order="n")
        feed = TS.stream_tar_shards(spark, f"{root}/*.tar", f"{out}/log").drop("bytes")
        run = feed.writeStream.format("parquet").option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True)
        run.start(f"{out}/data").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("shard", "pos", "key", "ext", "label")


@query(
    "count_shard_entries",
    with_ctes("SELECT shard, count(*) AS n_images FROM fx_tar GROUP BY shard", "fx_tar"),
)
def count_shard_entries(spark, sf):
    return TS.count_shard_entries(spark, f"{tar_folder(spark, sf)}/*.tar")


@query(
    "sample_first_n",
    with_ctes("SELECT shard, pos, key, label FROM fx_tar ORDER BY shard, pos LIMIT 300", "fx_tar"),
)
def sample_first_n(spark, sf):
    scan = TS.scan_tar_shards(spark, f"{tar_folder(spark, sf)}/*.tar")
    return S.sample_first_n(scan, 300).select("shard", "pos", "key", "label")


def npz_folder(spark, sf, source: str) -> str:
    """A source written by the array sink, one file per (patient, slide)."""
    root = scratch_path(spark, f"npz-{source}")
    NZ.write_npz(fx.patches(spark, sf, source), root)
    return root


@query(
    "scan_npz",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT foundation, patient || '_' || slide || '.npz' AS file, patient, slide, name, label, {fx.sql_vec('x')} AS x FROM fx_{s}" for s in "abc"
        ),
        "fx_a",
        "fx_b",
        "fx_c",
    ),
)
def scan_npz(spark, sf):
    """All sources, a folder of array files each."""
    read = {s: NZ.scan_npz(spark, f"{npz_folder(spark, sf, s)}/*.npz") for s in "abc"}
    df = reduce(DataFrame.unionByName, [d.withColumn("foundation", F.lit(s)) for s, d in read.items()])
    return df.withColumn("x", fx.vec_text("x"))


def embedding_store(spark, sf) -> str:
    """All sources written by the partitioned sink, in two appends; ``val`` is unlabelled in part."""
    root = scratch_path(spark, "embeddings")
    for s in "abc":
        TB.sink_partitioned(fx.patches(spark, sf, s).withColumn("split", F.lit("train")), root)
    TB.sink_partitioned(fx.unlabelled(spark, sf).withColumn("split", F.lit("val")), root)
    return root


@query(
    "scan_embeddings",
    with_ctes(
        f"SELECT patient, slide, name, label, {fx.sql_vec('x')} AS x FROM fx_unlabelled WHERE label >= 0",
        "fx_unlabelled",
    ),
)
def scan_embeddings(spark, sf):
    df = TB.scan_embeddings(spark, embedding_store(spark, sf), "a", "val")
    return df.select("patient", "slide", "name", "label", fx.vec_text("x").alias("x"))


@query("discover_sources", "SELECT DISTINCT unnest(['a', 'b', 'c']) AS foundation FROM embeddings")
def discover_sources(spark, sf):
    return TB.discover_sources(spark, embedding_store(spark, sf))


@query(
    "sink_partitioned",
    with_ctes(
        """SELECT foundation, 'train' AS split, count(*) AS n, count(DISTINCT slide) AS n_slides FROM (
            SELECT foundation, slide FROM fx_a UNION ALL SELECT foundation, slide FROM fx_b UNION ALL SELECT foundation, slide FROM fx_c)
            GROUP BY foundation
        UNION ALL SELECT 'a', 'val', count(*), count(DISTINCT slide) FROM fx_a""",
        "fx_a",
        "fx_b",
        "fx_c",
    ),
)
def sink_partitioned(spark, sf):
    stored = spark.read.parquet(embedding_store(spark, sf))
    return stored.groupBy("foundation", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("slide").alias("n_slides")
    )


@query(
    "scan_mapping_csv",
    with_ctes('SELECT "Name", "Patient", "Slide" FROM fx_mapping', "fx_mapping"),
)
def scan_mapping_csv(spark, sf):
    path = scratch_path(spark, "mapping")
    m = fx.mapping(spark, sf)
    # Some ids are spelled as floats, as spreadsheet exports do.
    odd = F.when(F.col("Patient") % 2 == 0, F.concat(F.col("Patient").cast("string"), F.lit(".0"))).otherwise(
        F.col("Patient").cast("string")
    )
    m.withColumn("Patient", odd).write.option("header", True).csv(path)
    return TB.scan_mapping_csv(spark, path)


@query(
    "scan_selection_manifest",
    with_ctes("SELECT patch_uid, label_int, a_order, b_order FROM fx_selection", "fx_selection"),
)
def scan_selection_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    selection(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return TB.scan_selection_manifest(spark, path, ("a", "b"))


def image_folder(spark, sf) -> str:
    """Write every tile as a PNG below a folder per shard; some carry other suffixes."""
    root = scratch_path(spark, "images")
    for i in range(SHARDS):
        make_dirs(f"{root}/part-{i}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                suffix = "txt" if r.n % 10 == 9 else "PNG" if r.n % 10 == 4 else "png"
                _publish(f"{root}/part-{r.shard_no}/{r.key}.{suffix}", png(r.w, r.h, r.rgb))
                n += 1
        yield pd.DataFrame({"n": [n]})

    labelled_images(spark, sf).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return root


@query(
    "scan_images",
    """SELECT 'part-' || (p_partkey % 8) || '/tile_' || p_partkey || CASE WHEN p_partkey % 10 = 4 THEN '.PNG' ELSE '.png' END AS relpath,
        true AS non_empty FROM part WHERE p_partkey % 10 <> 9""",
)
def scan_images(spark, sf):
    df = TB.scan_images(spark, image_folder(spark, sf))
    return df.select(
        F.regexp_extract("path", r"(part-\d+/[^/]*)$", 1).alias("relpath"), (F.col("size_bytes") > 0).alias("non_empty")
    )


@query(
    "decode_images",
    """SELECT 'tile_' || p_partkey AS key, 16 AS w, 16 AS h FROM part WHERE p_partkey % 10 <> 9""",
)
def decode_images(spark, sf):
    """Decode the image files and check the pixels against the tiles they came from."""
    root = image_folder(spark, sf)
    got = TB.decode_images(spark, root).select(
        F.regexp_extract("path", r"(tile_\d+)\.[^/]*$", 1).alias("key"), "w", "h", F.sha2("rgb", 256).alias("s")
    )
    made = image_bytes(spark, sf).select("key", F.sha2("rgb", 256).alias("s"))
    listed = TB.scan_images(spark, root).select(
        F.regexp_extract("filename", r"^(.*)\.[^.]*$", 1).alias("key")
    )
    return got.join(made, ["key", "s"], "left_semi").join(listed, "key", "left_semi").drop("s")


@query(
    "resolve_source_order",
    with_ctes(
        f"""WITH f AS (SELECT CASE {fx.SQL_VEC_NO} % 2 WHEN 0 THEN 'a' ELSE 'b' END AS foundation,
                CASE WHEN {fx.SQL_VEC_NO} % 3 = 0 THEN 'stainaug' ELSE 'stainaug_local' END AS suffix,
                CASE WHEN {fx.SQL_VEC_NO} % 2 = 1 AND {fx.SQL_VEC_NO} % 3 <> 0 THEN 'consolidated'
                    WHEN {fx.SQL_VEC_NO} % 5 = 0 THEN 'completed_parts' ELSE 'consolidated' END AS kind FROM fx_a),
            n AS (SELECT foundation, suffix, kind, count(*) AS n FROM f GROUP BY ALL),
            b AS (SELECT foundation, suffix, arg_min(kind, kind <> 'completed_parts') AS kind, arg_min(n, kind <> 'completed_parts') AS n FROM n GROUP BY ALL),
            g AS (SELECT * FROM (SELECT unnest(['a', 'b', 'c']) AS foundation), (SELECT unnest(['stainaug', 'stainaug_local']) AS suffix))
        SELECT foundation, suffix, coalesce(kind, 'missing') AS source_kind, coalesce(n, 0) AS n_rows FROM g LEFT JOIN b USING (foundation, suffix)""",
        "fx_a",
    ),
)
def resolve_source_order(spark, sf):
    n = fx.vec_no()
    found = fx.patches(spark, sf).select(
        F.when(n % 2 == 0, "a").otherwise("b").alias("foundation"),
        F.when(n % 3 == 0, "stainaug").otherwise("stainaug_local").alias("suffix"),
        F.when((n % 2 == 1) & (n % 3 != 0), "consolidated")
        .when(n % 5 == 0, "completed_parts")
        .otherwise("consolidated")
        .alias("source_kind"),
    )
    expected = fx.all_pairs(spark, ["a", "b", "c"], ["stainaug", "stainaug_local"])
    return TB.resolve_source_order(found, expected)


@query(
    "sink_run_history",
    """SELECT 'run-' || (o_orderkey % 2) AS run, o_orderpriority AS step, count(*) AS n FROM orders GROUP BY ALL""",
)
def sink_run_history(spark, sf):
    path = scratch_path(spark, "history")
    o = fx.table(spark, sf, "orders")
    for r in (0, 1):
        lines = o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_orderpriority").alias("step")).agg(
            F.count(F.lit(1)).alias("n")
        )
        TB.sink_run_history(lines.select(F.lit(f"run-{r}").alias("run"), "step", "n"), path)
    return spark.read.schema("run string, step string, n bigint").json(path)


@query(
    "sink_decode_failures",
    """SELECT 'tile_' || p_partkey AS key, 'ValueError: expected 768 bytes, got 767' AS error FROM part WHERE p_partkey % 31 = 0""",
)
def sink_decode_failures(spark, sf):
    """Embed tiles of which some are truncated; the failures land in a quarantine table."""
    n = F.substring("key", 6, 20).cast("long")
    imgs = image_bytes(spark, sf).withColumn(
        "rgb", F.when(n % 31 == 0, F.substring("rgb", 1, 767)).otherwise(F.col("rgb"))
    )
    root = scratch_path(spark, "embedded")
    out = EM.embed_batch(imgs, EM.ProjectionEncoder(16))
    out.write.parquet(f"{root}/all")
    good, bad = EM.split_failures(spark.read.schema(out.schema).parquet(f"{root}/all"))
    good.write.mode("append").parquet(f"{root}/good")
    bad.write.mode("append").parquet(f"{root}/failures")
    return spark.read.schema(bad.schema).parquet(f"{root}/failures").select("key", "error")


@query(
    "sink_predictions",
    with_ctes(
        """SELECT name AS "SubjectID", arg_min(cls, -p * 1e9 + cls * 1e-9)::INTEGER AS "Prediction" FROM fx_ensemble GROUP BY name""",
        "fx_ensemble",
    ),
)
def sink_predictions(spark, sf):
    root = scratch_path(spark, "predictions")
    rows = scored(spark, sf).withColumn("pred", E.argmax("proba"))
    TB.sink_predictions(rows, f"{root}/csv", f"{root}/proba")
    return TB.scan_predictions(spark, f"{root}/csv")


# --- streams ------------------------------------------------------------------------------------

FILES_PER_APPEND = 2
BOUNDS = ("2024-01-08", "2024-01-16", "2024-01-23")


def feed_folder(spark, sf) -> str:
    """The live directory: four appends in time order, as a writer would produce them."""
    root = scratch_path(spark, "feed")
    feed = fx.feed(spark, sf)
    edges = [None, *BOUNDS, None]
    for lo, hi in zip(edges, edges[1:]):
        part = feed
        if lo:
            part = part.where(F.col("mtime") >= F.lit(lo).cast("timestamp"))
        if hi:
            part = part.where(F.col("mtime") < F.lit(hi).cast("timestamp"))
        part.repartition(FILES_PER_APPEND).write.mode("append").parquet(root)
    return root


def live(spark, sf):
    return ST.read_feed(spark, feed_folder(spark, sf), FILES_PER_APPEND)


cte(
    "fx_appends",
    """SELECT *, (mtime >= TIMESTAMP '2024-01-08')::INTEGER + (mtime >= TIMESTAMP '2024-01-16')::INTEGER
        + (mtime >= TIMESTAMP '2024-01-23')::INTEGER AS batch FROM fx_feed""",
    "fx_feed",
)


@query(
    "stream_ingest",
    with_ctes(
        """SELECT patch_uid, path, cls FROM fx_appends WHERE size > 0
        QUALIFY row_number() OVER (PARTITION BY patch_uid ORDER BY batch, mtime, path) = 1""",
        "fx_appends",
    ),
)
def stream_ingest(spark, sf):
    out = ST.stream_ingest(live(spark, sf), scratch_path(spark, "ingest"))
    return out.select("patch_uid", "path", "cls")


@query(
    "stream_commit",
    with_ctes(
        """SELECT batch, count(*) AS n_data, count(*) AS n_registered FROM (SELECT patch_uid, batch FROM fx_appends WHERE size > 0
            QUALIFY row_number() OVER (PARTITION BY patch_uid ORDER BY batch, mtime, path) = 1) GROUP BY batch""",
        "fx_appends",
    ),
)
def stream_commit(spark, sf):
    """Replay a batch and lose a registry entry: both leave the committed state unchanged."""
    from tilewright.session import materialize

    root = scratch_path(spark, "commit")
    committed = ST.stream_ingest(live(spark, sf), root)
    run = ST.run_id(spark, f"{root}/ckpt")
    # Replay batch 1 from its own input, then drop batch 2's registry and recover it.
    again = committed.where(F.col("block") == f"{run}-1").drop("block")
    ST.committer(f"{root}/data", f"{root}/registry", f"{root}/ckpt")(materialize(again, "replay"), 1)
    kept = ST.written(spark, f"{root}/registry", "patch_uid string")
    partial = scratch_path(spark, "registry")
    for (block,) in kept.where(F.col("block") != f"{run}-2").select("block").distinct().collect():  # one row per batch
        register(kept.where(F.col("block") == block).select("patch_uid"), partial, block, "patch_uid")
    ST.recover(spark, f"{root}/data", partial)
    data = ST.written(spark, f"{root}/data", "patch_uid string")
    reg = ST.written(spark, partial, "patch_uid string")
    n = data.groupBy("block").agg(F.count(F.lit(1)).alias("n_data"))
    r = reg.groupBy("block").agg(F.count(F.lit(1)).alias("n_registered"))
    batch = F.substring_index("block", "-", -1).cast("int").alias("batch")
    return n.join(r, "block").select(batch, "n_data", "n_registered")


@query(
    "stream_min_age",
    with_ctes(
        """SELECT patch_uid, path, cls FROM fx_appends WHERE size > 0
        QUALIFY row_number() OVER (PARTITION BY patch_uid ORDER BY batch, mtime, path) = 1""",
        "fx_appends",
    ),
)
def stream_min_age(spark, sf):
    """The newest files are held when the feed is drained, and a timer passes them a few seconds later."""
    root = scratch_path(spark, "min-age")
    feed = live(spark, sf)
    newest = fx.feed(spark, sf).agg(F.max("mtime").cast("double")).first()[0] or 0.0
    due = time.time() + 15
    ST.stream_min_age(feed, root, due - newest)
    time.sleep(max(due + 2 - time.time(), 0))
    out = ST.stream_min_age(feed, root, due - newest)
    return out.select("patch_uid", "path", "cls")


@query(
    "stream_dedup",
    with_ctes(
        f"""SELECT patch_uid, path, cls FROM fx_appends WHERE {sql_hash32('reg', 'patch_uid')} % 10 <> 0
        QUALIFY row_number() OVER (PARTITION BY patch_uid ORDER BY batch, mtime, path) = 1""",
        "fx_appends",
    ),
)
def stream_dedup(spark, sf):
    from tilewright.functions.hashing import hash32

    registry = fx.feed(spark, sf).where(hash32("reg", "patch_uid") % 10 == 0).select("patch_uid").distinct()
    out = ST.stream_dedup(live(spark, sf), scratch_path(spark, "dedup"), registry)
    return out.select("patch_uid", "path", "cls")


def stream_targets(spark, sf) -> dict[str, int]:
    """Half of each class: a quota that the feed fills in the course of its batches."""
    rows = fx.feed(spark, sf).groupBy("cls").count().collect()  # one row per class
    return {r["cls"]: r["count"] // 2 for r in rows}


@query(
    "stream_quota",
    with_ctes(
        f"""SELECT patch_uid, path, cls FROM fx_appends JOIN (SELECT cls, count(*) // 2 AS q FROM fx_feed GROUP BY cls) USING (cls)
        WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY cls ORDER BY batch, {fx.sql_u(42, 'path')}, path) <= q""",
        "fx_appends",
    ),
)
def stream_quota(spark, sf):
    out = ST.stream_quota(live(spark, sf), scratch_path(spark, "quota"), stream_targets(spark, sf))
    return out.select("patch_uid", "path", "cls")


@query(
    "stream_class_counts",
    with_ctes("SELECT cls, count(*) AS n FROM fx_feed WHERE size > 0 GROUP BY cls", "fx_feed"),
)
def stream_class_counts(spark, sf):
    return ST.stream_class_counts(live(spark, sf), scratch_path(spark, "counts"))
