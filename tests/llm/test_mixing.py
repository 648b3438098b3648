import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def filled(sizes, weights, share, epochs):
    """Water-filling step by step: clamp, reshare the excess by weight, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        goal = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s: epochs * sizes[s] for s in rest if goal[s] > epochs * sizes[s]}
        if not over:
            return capped | goal
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 5}, {"a": 7}, {"a": 0, "b": 10}, {"a": 30, "b": 1, "c": 1, "d": 900, "e": 2}])
@pytest.mark.parametrize("share", [0.4, 1.5, 1.9])
def test_targets(spark, sizes, share):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), share, 2.0).collect()}
    assert got == pytest.approx(filled(sizes, (3, 1, 2), share, 2.0))


def test_many_sources(spark):
    """Caps spread over 12 orders of magnitude, one source twice as large as all others: many rounds, ranks over several parts."""
    sizes = {f"s{i}": int(1.03 ** (i * 7919 % 900)) for i in range(900)} | {None: 3, "": 10**12, "\U0001f600": 5, "\uffff": 5}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        ranks = {r["source"]: r["rank"] for r in mixing.ranked(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == pytest.approx(filled(sizes, (3, 1, 2), 1.5, 2.0))
    assert ranks == {s: i for i, s in enumerate([*sorted(s for s in sizes if s is not None), None])}


def test_no_sources_or_no_weight(spark):
    none = spark.createDataFrame([], "source string, size long")
    assert mixing.targets(none, (3, 1, 2), 1.5, 2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.targets(none, (3, 0), 1.5, 2.0)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37)), "en", ["a", "b", "c", None][i % 7 % 4], None) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_taken(docs):
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_copies(docs):
    taken = mixing.mix(docs)
    words = {r["doc_id"]: r["n"] for r in mixing.copies(docs, taken).groupBy("doc_id").agg(F.sum(mixing.n_spaced("text")).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in taken.collect() if r["taken"] or not r["size"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in mixing.copies(docs, taken).collect())
