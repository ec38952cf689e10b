"""Unit and property tests beside the SQL checks."""

import hashlib
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import masks as M
from tilewright.functions import text as TX
from tilewright.functions import vectors as VX
from tilewright.functions.hashing import hash32, u01
from tilewright.operators import calibrate as C
from tilewright.operators import embed as EM
from tilewright.operators import ensemble as EN
from tilewright.operators import evaluate as E
from tilewright.operators import folds as FO
from tilewright.operators import heads as H
from tilewright.operators import joins as J
from tilewright.operators import ontology as O
from tilewright.operators import ranking as R
from tilewright.operators import registry as RG
from tilewright.operators import sample as S
from tilewright.operators import stain as ST
from tilewright.operators import validate as V
from tilewright.plans import fixtures as fx
from tilewright.plans import pixel as PX
from tilewright.plans.curate import STRUCTURES
from tilewright.schema import EXTERNAL_CLASSES, class_table
from tilewright.session import scratch_path
from tilewright.streaming import ingest as SI
from tilewright.streaming import keys as SK

SF = "/root/testdata/sf0.001"


def u_py(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def skewed(spark, n=3000):
    """Two thirds of the rows share one group."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (i % 11).cast("string"))).alias("label"),
        F.concat(F.lit("k"), i.cast("string")).alias("name"),
    )


# --- ranking and sampling ---------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_bottom_k_is_exact_and_ignores_partitioning(spark, parts):
    df = skewed(spark)
    got = {(r["label"], r["name"]) for r in R.bottom_k(df.repartition(parts), ["label"], 40, "name", 5, buckets=16).collect()}
    rows = [(r["label"], r["name"]) for r in df.collect()]
    want = set()
    for g in {r[0] for r in rows}:
        names = sorted((n for lab, n in rows if lab == g), key=lambda n: (u_py(5, n), n))
        want |= {(g, n) for n in names[:40]}
    assert got == want


def test_quota_table_and_missing_groups(spark):
    quota = spark.createDataFrame([("hot", 7), ("g0", 2)], "label string, k int")
    got = R.bottom_k(skewed(spark), ["label"], quota, "name", 5).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"hot": 7, "g0": 2}


def test_ranks_are_dense(spark):
    u = u01(1, "name")
    ranked = R.rank_in_group(skewed(spark), ["label"], R.hash_bucket(u, 32), [u, F.col("name")])
    bad = ranked.groupBy("label").agg(
        F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d")
    ).where("n <> m OR n <> d")
    assert bad.isEmpty()


def test_exact_selection_refuses_a_short_class(spark):
    df = skewed(spark).withColumn("label", F.lit("CT")).withColumnRenamed("name", "patch_uid")
    with pytest.raises(Exception, match="too few rows for class IC"):
        S.select_exact_per_class(df, 5, class_table(spark, EXTERNAL_CLASSES)).collect()


def test_split_falls_back_without_two_rows_per_class(spark):
    df = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n3")], "label string, name string")
    assert {r["role"] for r in S.stratified_split(df, 0.3).collect()} == {"fit"}


def test_folds_keep_groups_together(spark):
    rows = FO.group_kfold(fx.patches(spark, SF), 5, forced=("patient-007",))
    per = rows.groupBy("patient").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("f")).collect()
    assert all(r["n"] == 1 for r in per)
    assert [r["patient"] for r in per if r["f"] == -1] == ["patient-007"]
    assert {r["f"] for r in per} == {-1, 0, 1, 2, 3, 4}
    sizes = [r["count"] for r in rows.where("fold >= 0").groupBy("fold").count().collect()]
    assert max(sizes) < 1.5 * min(sizes)


# --- text, vectors, gates ------------------------------------------------------------------


def test_structure_mapping(spark):
    df = spark.createDataFrame(list(STRUCTURES), "name string, acronym string")
    out = df.select(
        O.structure_to_class("name", "acronym", "strict").alias("s"),
        O.structure_to_class("name", "acronym", "loose").alias("l"),
    ).collect()
    assert [r["s"] for r in out] == ["CT", "MP", "PN", "NC", None, None, "IC", None]
    assert [r["l"] for r in out] == ["CT", "MP", "PN", "NC", None, None, "IC", "CT"]


def test_ids_do_not_truncate(spark):
    row = spark.range(1).select(
        TX.safe_patient(F.lit("123456")).alias("p"), TX.safe_slide(F.lit("7")).alias("s"), TX.safe_slide(F.lit("a/b")).alias("t")
    ).first()
    assert tuple(row) == ("patient-123456", "slide-0007", "slide-a-b")


def test_filename_with_underscores_in_the_specimen(spark):
    df = spark.createDataFrame([("A_b-1.2_33_0_512_d0_ct.PNG",), ("A_33_0_512_d0_ZZ.png",), ("x.png",)], "filename string")
    rows = TX.parse_patch_filename(df).collect()
    assert [(r["specimen"], r["image_id"], r["label"]) for r in rows] == [("A_b-1.2", 33, "CT")]


def test_bad_uid_fails(spark):
    with pytest.raises(Exception, match="unexpected patch uid"):
        TX.parse_patch_uid(spark.createDataFrame([("nope",)], "patch_uid string")).collect()


def test_chunk_bounds():
    assert [len(VX.chunk_bounds(d, 768)) for d in (2560, 1536, 4608)] == [4, 2, 6]
    assert VX.chunk_bounds(64, 30, 16) == [(0, 30), (30, 60)]
    assert VX.chunk_bounds(10, 30, 16) == [(0, 10)]


def test_gates_abort(spark):
    bad = fx.bad_vectors(spark, SF, 12)
    with pytest.raises(Exception, match="allowed share"):
        V.finite_gate(bad, "threshold").select(F.sum(F.col("x")[0])).collect()
    with pytest.raises(Exception, match="allowed share"):
        V.finite_gate(bad, "abort").select(F.sum(F.col("x")[0])).collect()
    zeroed = V.finite_gate(bad, "zero")
    assert zeroed.where(~VX.is_finite("x")).isEmpty()


def test_label_disagreement_fails(spark):
    a, b = fx.patches(spark, SF, "a"), fx.patches(spark, SF, "b").withColumn("label", F.lit(3).cast("short"))
    with pytest.raises(Exception, match="labels disagree"):
        J.align_sources({"a": a, "b": b}).select(F.sum("label")).collect()


def test_no_donor_fails(spark):
    v = spark.createDataFrame([("v1", "p1", 1)], "view string, patient string, label smallint")
    d = spark.createDataFrame([("d1", "p1", 2)], "name string, patient string, label smallint")
    with pytest.raises(Exception, match="no donor"):
        J.donor_theta_join(v, d).collect()


@pytest.mark.parametrize("scheme", ["random", "balanced"])
def test_masks_cover_every_feature(scheme):
    masks = M.feature_masks(64, 5, 0.3, 8, scheme, 1, "s")
    assert set().union(*map(set, masks)) == set(range(64))
    assert all(m == sorted(set(m)) for m in masks)


# --- heads -------------------------------------------------------------------------------------


def _xy(spark, source="b"):
    rows = fx.patches(spark, SF, source).select("x", "label").collect()
    return np.array([r["x"] for r in rows], dtype=float), np.array([r["label"] for r in rows])


def _coef(heads, cls, start=0):
    r = [h for h in heads if h["cls"] == cls and h["start"] == start][0]
    return np.array(r["coef"]), r["intercept"]


def test_ridge_matches_the_closed_form(spark):
    x, y = _xy(spark)
    heads = H.fit_ridge_heads(fx.patches(spark, SF, "b").repartition(5), size=32, alpha=10.0).collect()
    classes, n = np.unique(y, return_counts=True)
    w = (len(y) / (len(classes) * n))[np.searchsorted(classes, y)]
    for c in classes:
        t = np.where(y == c, 1.0, -1.0)
        mx, mt = (w @ x) / w.sum(), (w @ t) / w.sum()
        xc = x - mx
        beta = np.linalg.solve((xc * w[:, None]).T @ xc + 10.0 * np.eye(32), (xc * w[:, None]).T @ (t - mt))
        coef, b = _coef(heads, c)
        np.testing.assert_allclose(coef, beta, rtol=1e-7, atol=1e-10)
        assert abs(b - (mt - mx @ beta)) < 1e-9


def test_logistic_is_stationary(spark):
    x, y = _xy(spark)
    alpha = 1e-2
    heads = H.fit_logistic_heads(fx.patches(spark, SF, "b"), size=32, alpha=alpha, max_iter=200).collect()
    n, k = len(y), len(np.unique(y))
    for c in np.unique(y)[:3]:
        coef, b = _coef(heads, c)
        w = np.where(y == c, n / (k * (y == c).sum()), 1.0)
        r = w * (1 / (1 + np.exp(-(x @ coef + b))) - (y == c))
        grad = x.T @ r / n + alpha * coef
        assert np.abs(grad).max() < 1e-3 and abs(r.mean()) < 1e-3


@pytest.mark.parametrize("weighting", ["positive", "own"])
def test_logistic_heads_reach_their_minimum_in_few_jobs(spark, weighting, monkeypatch):
    df = fx.patches(spark, SF, "a").where("label >= 0")
    passes = []
    real = H.logistic_gradients
    monkeypatch.setattr(H, "logistic_gradients", lambda *a: passes.append(1) or real(*a))
    alpha = 1e-3
    heads = H.fit_logistic_heads(df, size=32, alpha=alpha, weighting=weighting).collect()
    assert len(passes) < 150
    rows = df.collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["label"] for r in rows])
    classes = np.unique(y)
    assert sorted((h["start"], h["cls"]) for h in heads) == [(a, c) for a in (0, 32) for c in classes]
    balanced = {c: len(y) / (len(classes) * (y == c).sum()) for c in classes}
    for h in heads:
        xc, hit = x[:, h["start"] : h["stop"]], y == h["cls"]
        w = np.array([balanced[v] if weighting == "own" or v == h["cls"] else 1.0 for v in y])
        coef = np.array(h["coef"])
        r = w * (1 / (1 + np.exp(-(xc @ coef + h["intercept"]))) - hit)
        grad = (xc.T @ r + alpha * len(y) * coef) / w.sum()
        assert np.abs(grad).max() < 1.1e-5 and abs(r.sum() / w.sum()) < 1.1e-5


def test_logistic_head_of_a_single_class_and_flat_dimensions(spark):
    rows = [("s", 0, [float(i), 1.0]) for i in range(20)]
    schema = "foundation string, label int, x array<float>"
    only = H.fit_logistic_heads(spark.createDataFrame(rows, schema), size=2, min_dim=1).collect()
    assert len(only) == 1 and only[0]["intercept"] > 10 and np.isfinite(only[0]["coef"]).all()
    both = spark.createDataFrame([*rows, *[("s", 1, [30.0 - i, 1.0]) for i in range(20)]], schema)
    got = H.fit_logistic_heads(both, size=2, min_dim=1, alpha=1e-2).collect()
    assert [h["cls"] for h in got] == [0, 1] and np.isfinite([h["coef"] for h in got]).all()
    assert H.fit_logistic_heads(both.limit(0), size=2, min_dim=1).count() == 0


def test_lda_matches_the_quadratic_form(spark):
    x, y = _xy(spark)
    df = fx.patches(spark, SF, "b")
    bank = H.head_bank(H.fit_shrinkage_lda(df, 0.1))
    got = H.head_posterior(bank["b"][0], x)
    classes = np.unique(y)
    mu = np.stack([x[y == c].mean(axis=0) for c in classes])
    pooled = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, mu)) / (len(y) - 1)
    cov = 0.9 * pooled + 0.1 * np.trace(pooled) / 32 * np.eye(32)
    prior = np.log([(y == c).sum() for c in classes])
    d = x[:, None, :] - mu[None]
    s = -0.5 * np.einsum("ncj,jk,nck->nc", d, np.linalg.inv(cov), d) + prior
    p = np.exp(s - s.max(axis=1, keepdims=True))
    np.testing.assert_allclose(got[:, classes], p / p.sum(axis=1, keepdims=True), atol=1e-8)


def test_posteriors_sum_to_one_and_bad_rows_are_uniform():
    head = H.Head("logistic", 0, 2, np.ones((2, 10)), np.zeros(10), np.ones(10, dtype=bool))
    p = H.head_posterior(head, np.array([[0.1, 0.2], [np.nan, 0.0], [-1e5, -1e5]]))
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    np.testing.assert_allclose(p[1:], 0.1)
    ridge = H.Head("ridge", 0, 2, np.ones((2, 10)), np.zeros(10), np.arange(10) < 9)
    assert H.head_posterior(ridge, np.ones((1, 2)))[0, 9] < 1e-8


def test_ensemble_fit_and_predict(spark):
    base = {s: fx.patches(spark, SF, s) for s in "bc"}
    extra = fx.patches(spark, SF, "b").where("label = 3")
    model = EN.ensemble_fit(base, extra, size=32, grid_size=5)
    out = model.predict(J.align_sources(base), {s: f"x_{s}" for s in "bc"}, passes=2, keep=0.9)
    total = F.aggregate("proba", F.lit(0.0), lambda a, v: a + v)
    assert out.where(F.abs(total - 1) > 1e-9).isEmpty()
    assert len(model.thresholds) == 10 and set(model.bank) == {"b", "c"}


def test_a_million_groups_of_equal_size_share_no_task(spark):
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("patient"), F.lit(3).cast("short").alias("label"))
    placed = FO.fold_table(df, 5)
    sizes = [r["count"] for r in placed.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and set(sizes) == {200_000}
    largest = df.groupBy(F.floor(hash32("fold", "patient") / F.lit(2**32 // FO.PARTS))).count().agg(F.max("count")).first()[0]
    assert largest < 1_000_000 / FO.PARTS * 1.2


def test_small_groups_are_dealt_in_the_stated_order(spark):
    rng = np.random.default_rng(11)
    rows = [(f"p{g}", int(g % 3)) for g in range(300) for _ in range(int(rng.integers(1, 4)))]
    df = spark.createDataFrame(rows, "patient string, label smallint")
    drawn = {r.patient: r.h for r in df.select("patient", hash32("fold", "patient").alias("h")).distinct().collect()}
    size = {g: sum(p == g for p, _ in rows) for g in drawn}
    order = sorted(drawn, key=lambda g: (int(g[1:]) % 3, -size[g], drawn[g], g))
    want = {g: min(i % 10, 9 - i % 10) for i, g in enumerate(order)}
    assert {r.patient: r.fold for r in FO.fold_table(df, 5).collect()} == want


def test_one_pass_over_all_folds_equals_one_fit_for_each(spark):
    base = {s: fx.patches(spark, SF, s) for s in "bc"}
    folds = base["b"].select("patient").distinct().withColumn("fold", F.substring("patient", -3, 3).cast("int") % 4 - 1)
    kinds = ("ridge", "lda")
    want = EN.oof_run(base, folds, kinds=kinds, size=16, calibration=0.0)
    got = EN.oof_one_pass(base, folds, kinds=kinds, size=16)
    both = want.withColumnRenamed("proba", "p").join(got, ["name", "patient", "fold", "y"])
    gap = both.select(F.array_max(F.zip_with("p", "proba", lambda a, b: F.abs(a - b))).alias("d")).agg(F.count("*"), F.max("d")).first()
    assert gap[0] == want.count() == got.count() > 0 and gap[1] < 1e-9
    with pytest.raises(ValueError, match="depends on the fold"):
        EN.oof_one_pass(base, folds, "standard")


def test_heads_by_fold_leave_out_that_fold_only(spark):
    rows = fx.patches(spark, SF, "b").withColumn("fold", F.substring("patient", -3, 3).cast("int") % 4 - 1)
    every = {(r.fold, r.start, r.cls): r for r in H.ridge_heads_by_fold(rows, size=16).collect()}
    assert {k for k, *_ in every} == {0, 1, 2}
    for k in range(3):
        for r in H.fit_ridge_heads(rows.where(F.col("fold") != k).drop("fold"), size=16).collect():
            np.testing.assert_allclose(every[k, r.start, r.cls].coef, r.coef, atol=1e-9)
            assert abs(every[k, r.start, r.cls].intercept - r.intercept) < 1e-9


def test_candidate_counts_equal_direct_predictions(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(10), 200).round(2)  # rounding makes ties
    y = rng.integers(0, 10, 200)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, proba array<double>")
    grid, t = C.threshold_grid(7), [1.0, 0.5, 2.0, 1, 1, 1, 1, 0.9, 1, 1]
    rows = [tuple(r) for r in C.candidate_counts(df, t, 4, grid).collect()]
    for g, got in zip(grid, C.candidate_f1(rows, 4, len(grid))):
        cand = np.array(t, dtype=float)
        cand[4] = g
        conf = np.zeros((10, 10))
        np.add.at(conf, (y, (p / cand).argmax(axis=1)), 1)
        assert abs(got - C._macro_f1(conf, False)) < 1e-12


def test_auc_with_ties_equals_pair_counting(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 120)
    p = rng.dirichlet(np.ones(10), 120).round(1)
    df = spark.createDataFrame(
        [("c", 0, int(a), [float(v) for v in b]) for a, b in zip(y, p)], "config_id string, fold int, y int, proba array<double>"
    )
    num = den = 0.0
    for c in range(3):
        pos, neg = p[y == c, c], p[y != c, c]
        wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
        num, den = num + wins / len(neg), den + len(pos)
    for buckets in (1, 4, 4096):
        assert abs(E.weighted_auroc(df, buckets=buckets).first()["auroc"] - num / den) < 1e-12


def test_auc_with_hot_scores_null_labels_and_small_batches(spark):
    rng = np.random.default_rng(6)
    y = [None if v == 3 else int(v) for v in rng.integers(0, 4, 400)]
    p = np.where(rng.random((400, 10)) < 0.4, 0.0, rng.random((400, 10)).round(2))
    rows = [("c", i % 2, a, [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "config_id string, fold int, y int, proba array<float>")
    want = {}
    for fold in (0, 1):
        num = den = 0.0
        for c in range(3):
            pos = p[[i for i, v in enumerate(y) if i % 2 == fold and v == c], c].astype(np.float32)
            neg = p[[i for i, v in enumerate(y) if i % 2 == fold and v not in (None, c)], c].astype(np.float32)
            wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
            num, den = num + wins / len(neg), den + len(pos)
        want[fold] = num / den
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["fold"]: r["auroc"] for r in E.weighted_auroc(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(abs(got[f] - want[f]) < 1e-12 for f in (0, 1))
    assert E.weighted_auroc(df.limit(0)).count() == 0


def test_rasters_and_pixel_rows_agree(spark):
    from tilewright.operators import pixels as PI

    rng = np.random.default_rng(9)
    palette = [(200, 30, 30, "b"), (30, 200, 30, "a"), (30, 30, 200, "c"), (30, 30, 204, "a")]
    tiles, rows = [], []
    for t in range(40):
        base = np.array([e[:3] for e in palette])[rng.integers(0, 4 if t % 2 else 2, 30)]
        px = np.clip(base + rng.integers(-6, 7, (30, 3)), 0, 255).astype(np.uint8)
        px[: t % 30] = 255  # white
        tiles.append((t, px.tobytes()))
        rows += [(t, *map(int, v)) for v in px]
    tiles += [(40, b""), (41, None)]
    raster = spark.createDataFrame(tiles, "tile_id long, rgb binary")
    pixel = spark.createDataFrame(rows, "tile_id long, r int, g int, b int")
    text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for tol in (5.0, 12.0):
        assert text(O.nearest_color_join(raster, palette, tol)) == text(O.nearest_color_join(pixel, palette, tol))
        assert text(O.annotate_tiles(raster, palette, tol)) == text(O.annotate_tiles(pixel, palette, tol))
    assert text(PI.tissue_qc(raster, bg_max=0.4)) == text(PI.tissue_qc(pixel, bg_max=0.4))
    assert text(O.annotate_tiles(raster, [], 5.0)) == text(O.annotate_tiles(pixel, [], 5.0))
    plans = [O.annotate_tiles(raster, palette), PI.tissue_qc(raster), O.nearest_color_join(raster, palette)]
    assert all("Exchange" not in df._jdf.queryExecution().toString() for df in plans)


# --- registry, streaming, pixels --------------------------------------------------------------


def test_registry_is_all_or_nothing(spark):
    reg = spark.createDataFrame([("u1",)], "patch_uid string")
    with pytest.raises(ValueError, match="nothing inserted"):
        RG.registry_insert(reg, spark.createDataFrame([("u2",), ("u1",)], "patch_uid string"), ["patch_uid"])
    with pytest.raises(ValueError, match="nothing inserted"):
        RG.registry_insert(reg, spark.createDataFrame([("u2",), ("u2",)], "patch_uid string"), ["patch_uid"])
    assert RG.registry_insert(reg, spark.createDataFrame([("u2",)], "patch_uid string"), ["patch_uid"]).count() == 2


def test_known_ids_never_change(spark):
    one = RG.surrogate_keys(spark.createDataFrame([("b",), ("a",)], "k string"), None, "k", "id")
    known = {r["k"]: r["id"] for r in one.collect()}
    two = RG.surrogate_keys(spark.createDataFrame([("a",), ("c",), ("d",)], "k string"), one, "k", "id")
    ids = {r["k"]: r["id"] for r in two.collect()}
    assert {k: ids[k] for k in known} == known and sorted(ids.values()) == [1, 2, 3, 4]


def test_second_run_commits_nothing_and_partial_state_is_an_error(spark):
    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    fx.feed(spark, SF).write.parquet(folder)
    first = SI.stream_ingest(SI.read_feed(spark, folder), root).count()
    assert SI.stream_ingest(SI.read_feed(spark, folder), root).count() == first > 0
    half = scratch_path(spark, "r")
    SI.written(spark, f"{root}/registry", "patch_uid string").limit(3).write.partitionBy("block").parquet(half)
    with pytest.raises(RuntimeError, match="partially registered"):
        SI.recover(spark, f"{root}/data", half)


def _feed(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id bigint, path string, patch_uid string, cls string, m bigint, size bigint")
    df = df.select("event_id", "path", "patch_uid", "cls", F.timestamp_seconds("m").alias("mtime"), "size")
    df.coalesce(1).write.mode("append").parquet(folder)


def _uids(df):
    return sorted(r["patch_uid"] for r in df.collect())


def test_late_files_pass_and_a_timer_releases_young_ones_after_a_restart(spark):
    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    now = int(time.time())
    _feed(spark, folder, [(1, "p1", "u1", "CT", 1000, 5), (2, "p2", "u2", "CT", now, 5)])
    _feed(spark, folder, [(3, "p3", "u3", "IC", now - 10, 5), (4, "p4", "u4", "IC", 10, 5)])  # u4 is old and late
    feed = SI.read_feed(spark, folder, 1)
    assert _uids(SI.stream_min_age(feed, root, 40)) == ["u1", "u4"]
    assert _uids(SI.stream_min_age(feed, root, 40)) == ["u1", "u4"]  # nothing new, nothing due
    assert not any(name.startswith(("young", "passed")) for name in os.listdir(root))
    time.sleep(max(now + 42 - time.time(), 0))
    assert _uids(SI.stream_min_age(feed, root, 40)) == ["u1", "u2", "u3", "u4"]  # a quiet feed
    _feed(spark, folder, [(5, "p5", "u2", "CT", 20, 5)])
    got = SI.stream_min_age(feed, root, 40)
    assert _uids(got) == ["u1", "u2", "u3", "u4"] and {r["path"] for r in got.collect()} == {"p1", "p2", "p3", "p4"}
    assert _uids(SI.stream_dedup(feed, scratch_path(spark, "d"))) == ["u1", "u2", "u3", "u4"]


def test_quotas_hold_over_restarts_and_a_lost_checkpoint(spark):
    import shutil

    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    quota = {"CT": 5, "IC": 2, "LE": 3}
    _feed(spark, folder, [(i, f"p{i}", f"u{i}", "CT" if i % 2 else "IC", 1000 + i, 5) for i in range(6)])
    feed = SI.read_feed(spark, folder)
    counts = lambda df: {r["cls"]: r["count"] for r in df.groupBy("cls").count().collect()}
    assert counts(SI.stream_quota(feed, root, quota)) == {"CT": 3, "IC": 2}
    _feed(spark, folder, [(i, f"p{i}", f"u{i}", "CT", 1000 + i, 5) for i in range(10, 15)] + [(20, "z", "z", "LE", 5, 0), (21, "y", "y", "OT", 5, 9)])
    full = SI.stream_quota(feed, root, quota)
    assert counts(full) == {"CT": 5, "IC": 2}
    late = [r["path"] for r in full.where("event_id between 10 and 14").collect()]
    by_hash = spark.createDataFrame([(f"p{i}",) for i in range(10, 15)], "path string").orderBy(u01(42, "path"), "path").limit(2)
    assert sorted(late) == sorted(r["path"] for r in by_hash.collect())
    shutil.rmtree(f"{root}/ckpt")
    _feed(spark, folder, [(30, "q", "q", "LE", 1000, 5)])
    assert counts(SI.stream_quota(feed, root, quota)) == {"CT": 5, "IC": 2, "LE": 1}


def test_class_counts_after_a_lost_checkpoint(spark):
    import shutil

    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    for i in range(3):
        _feed(spark, folder, [(i, f"p{i}", f"u{i}", "CT", 1000 + i, 5)])
    assert SI.stream_class_counts(SI.read_feed(spark, folder, 1), root).collect() == [("CT", 3)]
    shutil.rmtree(f"{root}/ckpt")
    _feed(spark, folder, [(9, "p9", "u9", "CT", 2000, 5)])
    assert SI.stream_class_counts(SI.read_feed(spark, folder), root).collect() == [("CT", 4)]


def test_a_batch_opens_only_the_folders_that_may_hold_its_keys(spark):
    registry = scratch_path(spark, "registry")
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string").coalesce(1)
    for b in range(60):
        SK.register(keys([f"k{b}-{i}" for i in range(3)]), registry, f"b{b:03d}", "k")
    batch = keys(["k7-1", "k55-2", "new", None])
    met = SK.hits(batch, registry, "k")
    assert {"b007", "b055"} <= {b for b, _ in met} and len(met) <= 3
    assert sorted(r["k"] or "" for r in SK.without_known(batch, registry, "k").collect()) == ["", "new"]
    assert sorted(r["k"] or "" for r in SK.without_known(batch, registry, "k", "b007").collect()) == ["", "k7-1", "new"]
    assert SK.without_known(keys([]), registry, "k").count() == 0
    SK.register(keys([]), registry, "b007", "k")  # a replaced block
    assert "k7-1" in {r["k"] for r in SK.without_known(batch, registry, "k").collect()}


def test_a_lost_checkpoint_commits_nothing_twice(spark):
    import shutil

    root, folder = scratch_path(spark, "t"), scratch_path(spark, "f")
    rows = [(i, f"p{i}", f"u{i}", "CT", 1000 + i, 5) for i in range(4)]
    _feed(spark, folder, rows)
    SI.stream_ingest(SI.read_feed(spark, folder), root)
    shutil.rmtree(f"{root}/ckpt")
    _feed(spark, folder, [(9, "p9", "u9", "IC", 2000, 5), (10, "p1b", "u1", "IC", 3000, 5)])
    again = SI.stream_ingest(SI.read_feed(spark, folder), root)
    assert sorted(r["patch_uid"] for r in again.collect()) == ["u0", "u1", "u2", "u3", "u9"]


def test_unnamed_directories_come_last(spark):
    rows = [("u", "new_dir", "f", 1, 1), ("u", "b", "f", 1, 1), ("u", "a", "f", 1, 1)]
    df = spark.createDataFrame(rows, "patch_uid string, source_dir string, filename string, mtime_s bigint, size_bytes bigint")
    from tilewright.operators import dedup

    assert dedup.dedup_keep_first(df, source_order=["b", "a"]).first()["source_dir"] == "b"


def test_alignment_errors(spark):
    one = spark.createDataFrame([("p", "n", 1, [1.0], "a")], "patient string, name string, label smallint, x array<float>, foundation string")
    other = one.withColumn("name", F.lit("m"))
    with pytest.raises(ValueError, match="no overlapping keys"):
        J.align_sources({"a": one, "b": other})
    with pytest.raises(Exception, match="occurs twice"):
        J.align_sources({"a": one, "b": one.union(one)}).collect()


def test_stains_are_recovered(spark):
    rows = PX.profiles(spark, SF).where("valid").collect()
    assert len(rows) > 100
    for r in rows[:50]:
        he = np.array(r["he"]).reshape(3, 2)
        assert PX.angle_between(he[:, 0], PX.STAINS[:, 0]) < 12
        assert PX.angle_between(he[:, 1], PX.STAINS[:, 1]) < 12


def test_transfer_to_own_stain_without_jitter_keeps_colours():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 64, 256)
    img = np.array(PX.COLORS, dtype=np.uint8)[cells].reshape(16, 16, 3)
    own = ST.estimate(img)
    back = ST.restained(img, own, own, np.ones(2), np.zeros(2))
    assert np.abs(back.astype(int) - img.astype(int)).mean() < 6
    seen = {ST.moved(img, g).tobytes() for g in range(8)}
    assert len(seen) == 8 and all(sorted(x) == sorted(img.tobytes()) for x in seen)


def test_plane_normal_is_the_direction_of_least_variance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        od = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
        _, vec = np.linalg.eigh(np.cov(od, rowvar=False))
        assert abs(abs(ST.plane_normal(od) @ vec[:, 0]) - 1) < 1e-9


def test_empty_stain_library_is_an_error(spark):
    views = spark.createDataFrame([("k", "v")], "key string, view string")
    empty = spark.createDataFrame([], "slide string, he array<double>, maxc array<double>")
    with pytest.raises(ValueError, match="empty"):
        ST.stain_manifold_sample(views, empty, "discrete")


def test_encoder_contract(spark):
    class NoOpen:
        def encode(self, images):
            return None

    with pytest.raises(TypeError, match="open"):
        EM.embed_batch(PX.image_bytes(spark, SF), NoOpen())


def test_crowded_scores_spread_over_buckets(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([10.0 ** -rng.uniform(2, 12, 3000), 1 - 10.0 ** -rng.uniform(2, 12, 3000), [0.0, 1.0, 0.5]])
    df = spark.createDataFrame([(float(x),) for x in s], "s double").withColumn("b", E._score_bucket(F.col("s"), 1024))
    rows = sorted((r["s"], r["b"]) for r in df.collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    assert max(r["count"] for r in df.groupBy("b").count().collect()) < 20


def test_npz_with_crops(spark, tmp_path):
    from tilewright.sources.npz import scan_npz

    x = np.arange(24, dtype=np.float32).reshape(3, 2, 4)
    np.savez(f"{tmp_path}/a.npz", X=x, y=np.array([1, 2, 3]), names=np.array(["p", "q", "r"]), patient="P", slide="S")
    got = {r["name"]: r["x"] for r in scan_npz(spark, f"{tmp_path}/*.npz", "crops").collect()}
    assert got["q"] == x[1].tolist()
    with pytest.raises(Exception, match="lengths disagree"):
        scan_npz(spark, f"{tmp_path}/*.npz").collect()


def test_own_estimators_plug_in(spark):
    base = {s: fx.patches(spark, SF, s) for s in "bc"}
    seen = []

    def own(df, size, min_dim):
        seen.append(size)
        return H.fit_ridge_heads(df, size, min_dim, alpha=1.0)

    model = EN.ensemble_fit(base, size=16, grid_size=3, kinds=(own,))
    assert seen == [16] and {h.kind for bank in model.bank.values() for h in bank} == {"ridge"}


def test_an_own_kind_of_head_never_picks_an_absent_class():
    head = H.Head("centroid", 0, 2, np.ones((2, 10)), np.zeros(10), np.array([True] * 3 + [False] * 7))
    p = H.head_posterior(head, np.array([[0.5, 0.25], [-9.0, -9.0]]))
    np.testing.assert_allclose(p[:, :3], 1 / 3)
    assert (p[:, 3:] == 0).all()


def test_stacked_sources_are_normalised(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), (rng.normal(size=3) + i % 2).tolist(), (100 * (rng.normal(size=2) - i % 2)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "label smallint, x_a array<float>, x_b array<float>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    plain = [("s", lab, np.concatenate([unit(a), unit(b)]).tolist()) for lab, a, b in rows]
    want = H.fit_shrinkage_lda(spark.createDataFrame(plain, "foundation string, label smallint, x array<float>"))
    get = lambda h: {r["cls"]: [*r["coef"], r["intercept"]] for r in h.collect()}
    a, b = get(H.fit_stacked_lda(df, ["x_a", "x_b"])), get(want)
    assert a.keys() == b.keys() and all(np.allclose(a[c], b[c], rtol=1e-3, atol=1e-4) for c in a)


# --- shards and array files ------------------------------------------------------------------


def shard_rows(spark, n=60, shards=6):
    i = F.col("id")
    return spark.range(n).select(
        F.format_string("s-%02d.tar", i % shards).alias("shard"),
        F.format_string("k%04d", i).alias("key"),
        F.lit("png").alias("ext"),
        F.encode(F.repeat(F.format_string("image %d;", i), 40), "utf-8").alias("bytes"),
        F.when(i % 7 == 0, -1).otherwise(i % 10).cast("int").alias("label"),
    )


def spoil(path):
    with open(path, "wb") as f:
        f.write(b"\xff" * 5000)


def test_shards_round_trip_with_and_without_index(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    rows = shard_rows(spark)
    TS.write_tar_shards(rows, str(tmp_path))
    cols = ["shard", "key", "ext", "bytes", "label"]
    want = sorted(map(tuple, rows.select(*cols).collect()))
    assert sorted(map(tuple, TS.scan_tar_shards(spark, f"{tmp_path}/*.tar").select(*cols).collect())) == want
    assert TS.write_indexes(spark, f"{tmp_path}/*.tar") == 60
    ranged = TS.scan_tar_shards(spark, f"{tmp_path}/*.tar", split_bytes=4096)
    assert ranged.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, ranged.select(*cols).collect())) == want
    where = [("pos", ">=", 3), ("pos", "<=", 5), ("key", "!=", "k0020")]
    got = TS.scan_tar_shards(spark, f"{tmp_path}/*.tar", where=where, split_bytes=4096).collect()
    assert sorted(r["key"] for r in got) == sorted(f"k{i:04d}" for i in range(60) if 3 <= i // 6 <= 5 and i != 20)


def test_a_condition_on_the_shard_opens_no_other_shard(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    TS.write_tar_shards(shard_rows(spark), str(tmp_path))
    for i in range(1, 6):
        spoil(f"{tmp_path}/s-{i:02d}.tar")

    def scan(*where):
        return TS.scan_tar_shards(spark, f"{tmp_path}/*.tar", where=where)

    assert scan(("shard", "=", "s-00.tar")).count() == 10
    one = scan(("shard", "in", ["s-00.tar", "none"]))
    assert one.rdd.getNumPartitions() == 1
    assert one.where("pos < 3").count() == 3 and one.count() == 10  # filters of one query stay with it
    assert one.where("pos < 3").union(one.where("pos > 8")).count() == 4
    assert scan(("shard", "=", "none")).count() == 0
    with pytest.raises(Exception):
        scan().count()
    with pytest.raises(Exception, match="is not one of"):
        scan(("label", "=", 3)).count()


def test_a_changed_shard_makes_its_index_stale(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    TS.write_tar_shards(shard_rows(spark), str(tmp_path))
    TS.write_indexes(spark, f"{tmp_path}/*.tar")
    TS.write_tar_shards(shard_rows(spark, 120), str(tmp_path))
    with pytest.raises(Exception, match="has changed"):
        TS.scan_tar_shards(spark, f"{tmp_path}/*.tar").count()


def test_targets_meet_places_before_images_are_read(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    TS.write_tar_shards(shard_rows(spark), str(tmp_path))
    targets = spark.createDataFrame([("k0003",), ("k0031",), ("k0003",), ("gone",)], "key string")
    got = TS.fetch_targets(spark, f"{tmp_path}/*.tar", targets)
    want = shard_rows(spark).where("key IN ('k0003', 'k0031')")
    cols = ["shard", "key", "ext", "bytes", "label"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_a_failed_write_shows_nothing(spark, tmp_path):
    from tilewright.sources import npz as NZ
    from tilewright.sources import tarshards as TS

    bad = shard_rows(spark).withColumn("bytes", F.when(F.col("key") != "k0059", F.col("bytes")))
    with pytest.raises(Exception):
        TS.write_tar_shards(bad, f"{tmp_path}/tar")
    assert os.listdir(f"{tmp_path}/tar") == []
    rows = spark.sql(
        "SELECT 'P' AS patient, 'S' || (id % 4) AS slide, 'n' || id AS name, IF(id = 39, NULL, 1) AS label, array(1.0F) AS x FROM range(40)"
    )
    with pytest.raises(Exception):
        NZ.write_npz(rows, f"{tmp_path}/npz")
    assert os.listdir(f"{tmp_path}/npz") == []


def test_shards_that_lie_apart_are_refused(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    spark.dataSource.register(TS.TarShards)
    rows = shard_rows(spark, 12, 1).repartition(3).select("shard", "key", "ext", "bytes", "label")
    with pytest.raises(Exception, match="lie apart"):
        rows.write.format("tarshards").option("path", str(tmp_path)).mode("append").save()
    assert os.listdir(tmp_path) == []


def test_stream_code_needs_no_package_where_it_runs(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle
    from pyspark.sql.types import LongType, StructField, StructType

    from tilewright.shipping import by_value
    from tilewright.sources import tarshards as TS
    from tilewright.streaming import stateful as SX

    with by_value(SX.__name__, TS.__name__, TS.Conditions.__module__, TS.StagedWriter.__module__, TS.expand.__module__):
        data = cloudpickle.dumps((SX.Hold(StructType([StructField("mtime", LongType())]), 1.0), SX.Fill, TS.TarShards))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); assert 'tilewright' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], input=data, cwd=tmp_path, env=env, check=True)


def test_new_shards_stream_once_each_across_a_restart(spark, tmp_path):
    from tilewright.sources import tarshards as TS

    def run():
        feed = TS.stream_tar_shards(spark, f"{tmp_path}/in/*.tar", f"{tmp_path}/log").drop("bytes")
        out = feed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ckpt")
        out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["key"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    rows = shard_rows(spark)
    for n in (2, 2, 6):
        TS.write_tar_shards(rows.where(F.substring("shard", 3, 2).cast("int") < n).where(f"shard NOT IN ({done(tmp_path)})"), f"{tmp_path}/in")
        assert run() == sorted(f"k{i:04d}" for i in range(60) if i % 6 < n)


def done(tmp_path):
    names = os.listdir(f"{tmp_path}/in") if os.path.isdir(f"{tmp_path}/in") else []
    return ", ".join(f"'{n}'" for n in ["-", *names])


def test_npz_conditions_open_only_what_they_need(spark, tmp_path):
    from tilewright.sources import npz as NZ

    rows = spark.sql(
        "SELECT 'P' || (id % 3) AS patient, 'S' || (id % 6) AS slide, 'n' || id AS name, CAST(id % 5 AS INT) AS label, array(CAST(id AS FLOAT), 1.5F) AS x FROM range(60)"
    )
    NZ.write_npz(rows, str(tmp_path))
    cols = ["patient", "slide", "name", "label", "x"]
    for where, cond in (
        ([], "true"),
        ([("slide", "=", "S4")], "slide = 'S4'"),
        ([("label", "in", [1, 3]), ("name", ">", "n3")], "label IN (1, 3) AND name > 'n3'"),
        ([("patient", "startswith", "P1"), ("label", "!=", 2)], "patient = 'P1' AND label <> 2"),
    ):
        got = NZ.scan_npz(spark, f"{tmp_path}/*.npz", where=where).select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.where(cond).select(*cols).collect()))
    for name in os.listdir(tmp_path):
        if name.endswith(".npz") and name != "P1_S4.npz":
            spoil(f"{tmp_path}/{name}")
    assert NZ.scan_npz(spark, f"{tmp_path}/*.npz", where=[("file", "=", "P1_S4.npz")]).count() == 10
