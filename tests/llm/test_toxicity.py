import numpy as np
import pytest

from millrace.llm import toxicity


@pytest.fixture(scope="module")
def data():
    """Category b follows words and category a, so the chain has something to pass on."""
    r = np.random.RandomState(3)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [np.unique(r.randint(0, 50, 12)) for _ in range(1200)]
    a = np.array([3 in x or 4 in x for x in rows])
    b = np.array([5 in x for x in rows]) & a
    return vocabulary, rows, r.randint(0, toxicity.FOLDS, len(rows)), np.stack((a, b), axis=1).astype(int)


def test_chain_on_held_out_rows(data):
    vocabulary, rows, fold, y = data
    links = toxicity.chain(vocabulary, rows[:800], fold[:800], y[:800], ["a", "b"])
    assert links[1].earlier[0] > 0  # the earlier category's log-odds count
    p = np.array([toxicity.score(links, " ".join(vocabulary[i] for i in x).replace("w", "")) for x in rows[:1]])
    assert p.shape == (1, 2)
    for j, link in enumerate(links):
        odds = []
        for x in rows[800:]:
            before = []
            for k in links[: j + 1]:
                before.append(k.constant + sum(k.weights.get(vocabulary[i], 0.0) for i in x) + sum(u * v for u, v in zip(k.earlier, before)))
            odds.append(before[-1])
        got = toxicity.sigmoid(np.array(odds)) >= link.cut
        assert (got == y[800:, j]).mean() > 0.95


def test_logistic_finds_the_minimum():
    r = np.random.RandomState(5)
    lists = [np.flatnonzero(r.rand(6) < 0.4) for _ in range(300)]
    y = (r.rand(300) < 0.4).astype(float)
    x = toxicity.Rows(lists, 6, np.ones((300, 1)))
    w = toxicity.logistic(x, y, steps=500)
    gradient = x.back(toxicity.sigmoid(x.times(w)) - y) + np.append(np.ones(6), 0) * w
    assert np.abs(gradient).max() < 0.05


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} text", ) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 1), (3, None, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        links = toxicity.train(docs, labels)
        assert toxicity.reject(docs, links).count() == 20


def test_held_out_documents(spark):
    """Trained on half of the labelled documents, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    links = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.classify(docs, links).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "want").withColumnRenamed("quality", "q"), "doc_id").collect()
    assert sum(r["toxic"] == r["want"] for r in rows) / len(rows) > 0.97
    found = [r for r in rows if r["toxic"]]
    assert sum(r["want"] for r in found) / len(found) > 0.9 and sum(r["want"] for r in found) / sum(r["want"] for r in rows) > 0.9


def test_reruns_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    links = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    again = toxicity.train(docs.repartition(3), labels.where("doc_id % 2 = 0").repartition(3))
    assert [x.cut for x in again] == [x.cut for x in links]


def test_no_feature_is_lost(spark):
    """The links are those of a chain over all features of LEAST documents or more, counted here row by row."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.train(docs, labels)
    y = {r["doc_id"]: (int(r["quality"] == 0), int(r["toxic"] == 1)) for r in labels.collect()}
    rows = docs.join(labels.select("doc_id").distinct(), "doc_id").selectExpr("doc_id", "text", f"pmod(xxhash64(text), {toxicity.FOLDS}) AS fold").orderBy("doc_id").collect()
    sets = [toxicity.features(r["text"]) for r in rows]
    counts = {}
    for f in sets:
        for w in f:
            counts[w] = counts.get(w, 0) + 1
    every = sorted((w for w, n in counts.items() if n >= toxicity.LEAST), key=lambda w: (-counts[w], w))
    at = {w: i for i, w in enumerate(every)}
    want = toxicity.chain(every, [np.array(sorted(at[w] for w in f if w in at), np.int64) for f in sets], np.array([r["fold"] for r in rows]), np.array([y[r["doc_id"]] for r in rows]), ["low_quality", "toxic"])
    for a, b in zip(got, want, strict=True):
        assert a.category == b.category and a.cut == pytest.approx(b.cut, abs=1e-3)
        assert a.weights.keys() == b.weights.keys()
        assert list(a.weights.values()) == pytest.approx([b.weights[w] for w in a.weights], abs=1e-2)
