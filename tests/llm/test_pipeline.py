"""The stages in a row: each one's decisions take effect and what is clean stays."""

import numpy as np

import corpus_pipeline as P
from tilewright.llm.common import stored


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, make, tmp_path):
    passage, item = words(1, 60), words(2, 30)
    clean = {i: words(100 + i, 80) for i in range(20)}
    rows = [(i, t, "aa") for i, t in clean.items()]
    rows += [(50, None, "aa"), (51, "12 34", "aa"), (60, clean[3], "aa"), (61, clean[3] + " extra", "aa"), (70, words(5, 40) + " " + passage, "aa")]
    rows += [(71, words(6, 40) + " " + passage, "aa"), (80, words(7, 30) + " " + item + " " + words(8, 30), "aa")]
    docs = make(rows)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, ids = docs, {}
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, at, str(tmp_path)), "t")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        at, ids[name] = out, {r.doc_id for r in out.collect()}
    assert ids["language"] == {r[0] for r in rows} - {50, 51}
    assert ids["near_duplicates"] == ids["language"] - {60, 61}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    assert ids["decontaminate"] == ids["repeated_passages"] - {80}
    texts = {r.doc_id: r.text for r in at.collect()}
    assert all(texts[i] == t for i, t in clean.items())
    assert passage in texts[70] and passage not in texts[71] and texts[71].startswith(words(6, 40)[:150])
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids["decontaminate"]


def test_near_copies_at_0_82_are_linked(spark, make, tmp_path):
    first = [words(300 + k, 1) for k in range(104)]
    near, far = list(first), list(first)
    for at in (20, 60):
        near[at] = f"new{at}"  # 90 of 110 shingles
    for at in (20, 45, 70):
        far[at] = f"other{at}"  # 85 of 115
    docs = make([(1, " ".join(first)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_empty_documents_pass(spark, make, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make([(1, "a")]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_order():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontaminate", "packing"]
