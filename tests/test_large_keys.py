"""Queries on tables that the small ones do not show: keys past six digits, cells that are all full."""

import os

import pytest
from oracle_check import TABLES, compare
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def folder(tmp_path, **changed) -> str:
    """The small tables, with some replaced."""
    for t in TABLES:
        target = f"{tmp_path}/{t}.parquet"
        if t in changed:
            changed[t].write.parquet(f"{tmp_path}/_{t}")
            (part,) = [p for p in os.listdir(f"{tmp_path}/_{t}") if p.endswith(".parquet")]
            os.symlink(f"{tmp_path}/_{t}/{part}", target)
        else:
            os.symlink(f"{SMALL}/{t}.parquet", target)
    return str(tmp_path)


def same(spark, sf, key):
    import __spark_entry__ as e

    got = compare(spark, sf, key, e.queries(), e.oracle_sql())
    assert got["ok"] and got["rows"], got


@pytest.mark.parametrize("key", ["registry_upsert", "skip_completed"])
def test_configuration_numbers_of_seven_digits(spark, tmp_path, key):
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 999_950)
    same(spark, folder(tmp_path, part=part.coalesce(1)), key)


def test_plan_summary_without_a_scarce_cell(spark, tmp_path):
    one = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 3")
    full = one.crossJoin(spark.range(5).select("id")).withColumn("vec_id", F.col("vec_id") + F.col("id") * 23).drop("id")
    same(spark, folder(tmp_path, embeddings=full.coalesce(1)), "plan_summary")


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_dealt_tables_need_no_sort_and_grow_in_partitions(spark, monkeypatch):
    from tilewright.plans import fixtures as fx

    plan = _plan(fx.table(spark, SMALL, "lineitem"))
    assert "RoundRobin" not in plan and "hashpartitioning(l_orderkey" in plan
    monkeypatch.setitem(fx.DEALT, "lineitem", (("l_orderkey",), 100))
    assert fx.table(spark, SMALL, "lineitem").rdd.getNumPartitions() > fx.PARTS


def test_tile_pixels_come_from_arrow_batches_of_the_wanted_tiles(spark):
    from tilewright.plans.curate import rasters
    from tilewright.plans.pixel import image_bytes

    for df in (rasters(spark, SMALL), image_bytes(spark, SMALL)):
        assert "MapInArrow" in _plan(df) and "lambda" not in _plan(df)
    some = spark.createDataFrame([(3,), (5,), (-1,)], "tile_id bigint")
    got = {r[0]: r[1] for r in rasters(spark, SMALL, some).collect()}
    every = {r[0]: r[1] for r in rasters(spark, SMALL).collect()}
    assert got == {k: every[k] for k in (3, 5)}


def test_stain_estimate_pays_no_set_up_for_each_tile(monkeypatch):
    import numpy as np

    from tilewright.operators import stain as ST

    values = np.random.default_rng(5).normal(size=(77, 2))
    assert np.array_equal(ST.percentile(values, (1.0, 99.0)), np.percentile(values, (1.0, 99.0), axis=0))
    assert np.array_equal(ST.cross(values[0].repeat(2)[:3], [1.0, -2.0, 3.0]), np.cross(values[0].repeat(2)[:3], [1.0, -2.0, 3.0]))
    for slow in ("percentile", "cov", "cross"):
        monkeypatch.setattr(np, slow, None)
    assert ST.estimate(np.random.default_rng(6).integers(0, 256, 768, dtype=np.uint8)) is not None


def test_images_are_listed_and_decoded_in_tasks(spark, tmp_path):
    import struct
    import zlib

    from tilewright.plans.ingest import png
    from tilewright.sources import tables as TB

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    rgb = bytes(range(24))
    plain = png(4, 2, rgb)
    # The second row holds differences to the first: not a plain file.
    lines = b"\0" + rgb[:12] + b"\2" + bytes((b - a) % 256 for a, b in zip(rgb[:12], rgb[12:]))
    filtered = plain[:33] + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    grey = plain[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7\x09")) + chunk(b"IEND", b"")
    for name, data in {"p/a.png": plain, "p/q/b[1].PNG": filtered, "c.jpg": grey, "p/d.txt": b"no image", "p/e.png": plain[:-30], "_x.png": plain}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    rows = TB.decode_images(spark, str(tmp_path)).collect()
    got = {os.path.basename(r.path.replace("%5B", "[").replace("%5D", "]")): (r.w, r.h, bytes(r.rgb) if r.rgb else None, r.error) for r in rows}
    bad = (None, None, None, "not decodable")
    assert got == {"a.png": (4, 2, rgb, None), "b[1].PNG": (4, 2, rgb, None), "c.jpg": (2, 1, b"\7\7\7\x09\x09\x09", None), "d.txt": bad, "e.png": bad}
    assert len(rows) == 5
    listed = TB.scan_images(spark, str(tmp_path), content=True)
    assert "InMemoryFileIndex" not in _plan(listed)  # the driver holds no listing
    assert {r.filename: bytes(r.content) for r in listed.collect()} == {"a.png": plain, "b[1].PNG": filtered, "c.jpg": grey, "e.png": plain[:-30]}


def test_ranges_past_the_last_position_are_not_planned(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    rows = spark.range(300).selectExpr("'s.tar' shard", "format_string('k%04d', id) key", "'png' ext", "cast('x' as binary) bytes", "1 label")
    TS.write_tar_shards(rows, str(tmp_path))
    TS.write_indexes(spark, f"{tmp_path}/*.tar", 20)
    narrow = TS.TarReader(f"{tmp_path}/*.tar", split=4096, where='[["pos", "<=", 9]]').partitions()
    every = TS.TarReader(f"{tmp_path}/*.tar", split=4096).partitions()
    assert len(every) >= 300 * 2048 // 4096 - 1
    assert len(narrow) <= 11
    got = TS.scan_tar_shards(spark, f"{tmp_path}/*.tar", where=[("pos", "<=", 9)], split_bytes=4096).collect()
    assert sorted(r.pos for r in got) == list(range(10))
