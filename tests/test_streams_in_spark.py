"""What a stream's Python stages get: quotas are ranked by Spark, only young rows reach the state, tiles are made once."""

import datetime as dt
import time

from tilewright.plans import ingest as PI
from tilewright.session import scratch_path
from tilewright.streaming import ingest as SI


def _plans(monkeypatch) -> list[str]:
    """Physical plans of the blocks that are written from now on."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, write = [], DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]))
    return seen


def test_quotas_are_ranked_without_python(spark, monkeypatch):
    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    rows = spark.range(400).selectExpr("id event_id", "concat('p', id) path", "concat('u', id) patch_uid", "if(id % 4 = 0, 'CT', 'IC') cls", "timestamp_seconds(id) mtime", "1L size")
    rows.write.parquet(folder)
    plans = _plans(monkeypatch)
    out = SI.stream_quota(SI.read_feed(spark, folder), root, {"CT": 30, "IC": 500})
    assert {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()} == {"CT": 30, "IC": 300}
    assert plans and not any("Python" in p or "Pandas" in p for p in plans)


def test_only_young_rows_reach_the_state(spark, monkeypatch):
    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    now = time.time()
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    rows = [(1, "p1", "u1", "CT", at(now - 500), 5), (2, "p2", "u2", "CT", None, 5), (3, "p3", "u3", "CT", at(now + 300), 5), (4, "p4", "u4", "CT", at(now - 500), 0)]
    spark.createDataFrame(rows, SI.FEED).write.parquet(folder)
    held, remove = [], SI.remove

    def watched(session, path):
        if path.endswith("/young"):
            held.extend(r["patch_uid"] for r in session.read.parquet(path).collect())
        remove(session, path)

    monkeypatch.setattr(SI, "remove", watched)
    out = SI.stream_min_age(SI.read_feed(spark, folder), root, 40)
    assert sorted(r["patch_uid"] for r in out.collect()) == ["u1", "u2"]
    assert held == ["u3"]


def test_a_condition_on_keys_spares_the_other_tiles(spark):
    rows = PI.tar_samples(spark, "/root/testdata/sf0.001", "substring(key, 6) % 2 = 0")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter")  # the condition lies below both stages
    assert {r["n"] % 2 for r in rows.select("n").collect()} == {0}
