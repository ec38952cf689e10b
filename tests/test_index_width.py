"""The shared index is written, sorted and sent with the columns that a query reads."""

from tilewright.operators import joins as J
from tilewright.operators import validate as V
from tilewright.plans import curate

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_index_table_has_the_named_columns(spark):
    assert curate.ext_table(spark, SF, "patch_uid", "label").columns == ["patch_uid", "label"]


def test_blocks_are_listed_once_before_they_are_counted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "block_config_check", lambda blocks, declared: seen.append(blocks) or blocks)
    curate.block_config_check(spark, SF)
    assert seen[0].count() == seen[0].distinct().count()


def test_committed_uids_meet_narrow_index_rows(spark):
    index = spark.createDataFrame([("p1", "a", "CT"), ("p2", "x", "CT"), ("p3", "c", "CT"), ("p4", "d", "CT"), ("p5", "e", "CT")], "relpath string, patch_uid string, label string")
    live = spark.createDataFrame([(f"p{i}", 5, 9) for i in range(1, 5)], "relpath string, mtime_s long, size_bytes long")
    parsed = spark.createDataFrame([("p1", "a", "CT", 5, 9), ("p2", "b", "CT", 5, 9), ("p3", "c", "IC", 5, 9), ("p4", "d", "CT", 5, 9)], "relpath string, patch_uid string, label string, mtime_s long, size_bytes long")
    done = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "patch_uid string")
    out = J.reuse_index_join(index, live, parsed, done, ("CT", "IC"), 1000, 10)
    got = {r.relpath: r.status for r in out.collect()}
    assert got == {"p1": "already_committed", "p2": "identity_mismatch", "p3": "label_mismatch", "p4": "available", "p5": "missing_source"}
    joins = [line for line in plan(out).splitlines() if "Join LeftOuter" in line]
    assert "relpath" in joins[0] and "patch_uid" in joins[-1]  # the last one is the innermost


def test_queries_write_only_what_they_read(spark, monkeypatch):
    from tilewright.plans import sampling

    wrote, materialize = [], curate.materialize
    monkeypatch.setattr(curate, "materialize", lambda df, label: wrote.append(df.columns) or materialize(df, label))
    curate.selection(spark, SF)
    sampling.interleave_by_class(spark, SF)
    sampling.round_robin_report(spark, SF)
    sampling.quota_plan(spark, SF)
    sampling.per_specimen_cap(spark, SF)
    assert wrote == [["patch_uid", "label_int"], ["patch_uid", "label"], ["patch_uid", "label", "specimen"], ["label", "image_id"]]


def test_reuse_index_deals_the_listing_once(spark):
    out = curate.reuse_index_join(spark, SF)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_reuse_index_rows_give_the_status_of_the_joins(spark):
    index = [("p1", "a", "CT"), ("p1", "z", "CT"), ("p2", "x", "CT"), ("p3", "c", "CT"), ("p4", "d", "CT"), ("p5", "e", "CT"), ("p6", "f", "CT"), ("p7", "g", "XX"), ("p8", "h", "CT"), ("p9", "i", "CT")]
    live = [("p1", 5, 9), ("p1", 4, 0), ("p2", 5, 9), ("p3", 5, 9), ("p4", 5, 9), ("p6", 5, 9), ("p7", 5, 9), ("p8", 5, 9), ("p8", 995, 9), ("p9", 5, 0), ("other", 5, 9)]
    name = {"p1": ("a", "CT"), "p2": ("b", "CT"), "p3": ("c", "IC"), "p4": ("d", "CT"), "p7": ("g", "CT"), "p8": ("h", "CT"), "p9": ("i", "CT")}
    parsed = [(p, *name[p], m, z) for p, m, z in live if p in name]
    done = {"a", "b", "c"}
    joined = J.reuse_index_join(
        spark.createDataFrame(index, "relpath string, patch_uid string, label string"),
        spark.createDataFrame(live, "relpath string, mtime_s long, size_bytes long"),
        spark.createDataFrame(parsed, "relpath string, patch_uid string, label string, mtime_s long, size_bytes long"),
        spark.createDataFrame([(d,) for d in done], "patch_uid string"),
        ("CT", "IC"), 1000, 10,
    )
    rows = [(1, p, u, lab, None, None, True, None) for p, u, lab in index]
    for p, m, z in live:
        u, lab = name.get(p, (None, None))
        rows.append((1, p, u, lab, m, z, False, u in done if u else None))
    fields = "home long, relpath string, patch_uid string, label string, mtime_s long, size_bytes long, in_index boolean, committed boolean"
    got = J.reuse_index_rows(spark.createDataFrame(rows, fields), ("CT", "IC"), 1000, 10)
    want = sorted(map(tuple, joined.collect()))
    assert sorted(map(tuple, got.collect())) == want and len({w[3] for w in want}) == 8
