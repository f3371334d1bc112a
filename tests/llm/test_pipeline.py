"""The stages of corpus_pipeline against brute force, each on what its predecessor kept."""

import pytest
from test_operators import brute_jaccard, brute_repeats, classes, frame, corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    texts = corpus(5, 30) + ["### $$$ ### %%% ###"] * 2 + ["mail x@y.com now"]
    texts += ["SHOUT!! AT!! ALL!! OF!! THEM!!"] * 20
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, quality), (_, near), (_, suffix), (_, pii), (_, packing) = corpus_pipeline.STAGES
    first = quality(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(range(len(texts) - 23)) <= set(kept) and len(texts) - 1 not in kept
    ids = sorted(kept)
    links = [(ids[a], ids[b]) for a, b in brute_jaccard([kept[i] for i in ids])]
    want = {i for i, c in classes(ids, links).items() if i == c}
    second = near(spark, first, str(tmp_path))
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == want
    ids = sorted(want)
    rest, _ = brute_repeats([kept[i] for i in ids])
    third = suffix(spark, second, str(tmp_path))
    assert third.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in third.collect()}
    assert got == {i: None if kept[i] is None else b.decode("utf-8", "ignore") for i, b in zip(ids, rest, strict=True)}
    fourth = pii(spark, third, str(tmp_path))
    assert fourth.columns == docs.columns and {r["text"] for r in fourth.collect()} >= {"mail [EMAIL] now"}
    assert {r["doc_id"] for r in packing(spark, fourth, str(tmp_path)).collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(want)


def test_rows_that_repeat_an_id_or_have_none(spark, tmp_path):
    prose = corpus(8, 12)
    long, other, third, fourth = (t for t in [prose[-1], prose[-2] + " " + prose[-3], prose[-4] + " " + prose[-5], prose[-6] + " own words"])
    rows = [(1, long), (1, long), (None, long), (2, other), (2, third), (3, third), (None, fourth), (None, fourth), (None, None), (4, None), (4, "")]
    frame(spark, [t for _, t in rows], [i for i, _ in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_dup_stage(spark, docs, str(tmp_path)).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept if r["text"]), key=repr)
    assert got == sorted([(1, long), (2, other), (2, third), (None, fourth)], key=repr)
    out = corpus_pipeline.run(spark, str(tmp_path))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in out.collect() if r["doc_id"] is not None}
    assert tokens[1] > 500 and tokens[2] > 5


def test_a_task_takes_one_python_worker(spark, tmp_path):
    # Workers are taken in turn and kept, so two in one task doubled what every later stage held.
    frame(spark, corpus(5, 30)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name != "n-gram Jaccard join":
            assert stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1, name


def test_empty_table(spark, tmp_path):
    frame(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
