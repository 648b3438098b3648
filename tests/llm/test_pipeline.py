"""Each stage of the pipeline, and the whole, against plain Python on the smallest table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, packing, toxicity

from .test_linededup import by_hand as dedup_by_hand
from .test_nearcopies import groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert all(after.dtypes == before.dtypes for before, after in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_toxicity(spark, sf_dir, stages):
    before, after = stages[0]
    links = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r["doc_id"] for r in before.collect() if toxicity.score(links, r["text"])[1] < links[1].cut]
    assert sorted(want) == sorted(r["doc_id"] for r in after.collect())


def test_line_dedup(stages):
    before, after = stages[1]
    want = dedup_by_hand([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == [x[:2] for x in want]
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_dedup(stages):
    before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    root = groups([t for _, t in rows])
    assert sorted(r["doc_id"] for r in after.collect()) == [rows[i][0] for i in sorted(set(root))]


def test_mixing(stages):
    before, after = stages[3]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    words = Counter()
    for r in after.withColumn("n", mixing.n_spaced("text")).collect():
        words[r["doc_id"]] += r["n"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_packing_and_run(spark, sf_dir, stages):
    before, after = stages[4]
    ids = packing.Ids(packing.tokenizer_path())
    want = sum(len(ids.of(r["text"])) // 4 + 1 for r in before.collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    for out in (after, whole):
        assert out.agg(F.sum("length")).head()[0] == want
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert key(after) == key(whole)


def test_runs_do_not_disturb_each_other(spark, sf_dir):
    one = corpus_pipeline.run(spark, sf_dir)
    two = corpus_pipeline.run(spark, sf_dir)
    assert two.count() == one.count() > 0


def test_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
