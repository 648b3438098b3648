import pytest

from millrace.functions.vint import decode
from millrace.operators import index, retrieval

from .conftest import rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "cat dog cat"), (5, "cat"), (9, "cat the"), (70_000, "cat and dog"), (140_000, None), (3, "the and")], "doc_id long, text string")


def test_gaps_and_blocks(spark, docs):
    g = rows_of(index.gaps(index.postings(docs)).where("term = 'cat'").select("doc", "gap", "tf"))
    assert sorted(g) == [(0, 0, 2), (5, 5, 1), (9, 4, 1), (70_000, 69_991, 1)]
    b = {(r["term"], r["block"]): decode(bytes(r["postings"])) for r in index.build(docs).collect()}
    assert b["cat", 0] == [3, 0, 2, 5, 1, 4, 1] and b["cat", 1] == [1, 70_000, 1]


@pytest.mark.parametrize("wide", [False, True])
def test_round_trip(docs, wide):
    assert rows_of(index.read(index.build(docs, wide))) == rows_of(index.postings(docs))


def test_terms(docs):
    assert ("cat", 4, 5, 0, 70_000) in rows_of(index.terms(index.postings(docs)))


@pytest.mark.parametrize("query, want", [("cat dog AND the OR", {0, 3, 9, 70_000}), ("cat dog AND", {0, 70_000}), ("nothing", set()), ("the and AND", {3}), ("cat dog OR the AND", {9})])
@pytest.mark.parametrize("wide", [False, True])
def test_search(docs, query, want, wide):
    assert {r[0] for r in retrieval.search_index(index.build(docs, wide), query).collect()} == want
    assert {r[0] for r in retrieval.search_texts(docs, query).collect()} == want


def test_malformed(docs):
    for query in ("AND", "cat AND", "", "cat dog"):
        with pytest.raises(ValueError):
            retrieval.parse(query)
    with pytest.raises(ValueError):
        retrieval.parse("AND", strict=False)
    assert {r[0] for r in retrieval.search_texts(docs, "cat dog", strict=False).collect()} == {0, 70_000}


def test_snippets(spark):
    docs = spark.createDataFrame([(1, "cat " + "x" * 100), (2, "dog")], "doc_id long, text string")
    assert rows_of(retrieval.snippets(retrieval.search_texts(docs, "cat"), docs)) == [(1, "cat " + "x" * 76 + "...")]


def test_numbers_of_all_rows_at_once():
    """Rows are decoded together; what comes after a row's numbers doesn't touch the next row's."""
    import random

    import numpy as np

    from millrace.functions.vint import decode_each, encode

    r = random.Random(8)
    for most in (7, 30, 62):
        rows = [[r.randrange(-(2 ** r.randrange(1, most)), 2 ** r.randrange(1, most)) for _ in range(r.choice([0, 1, 3, 40, 700]))] for _ in range(60)]
        data = [encode(x) for x in rows]
        numbers, size = decode_each(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert size.tolist() == list(map(len, rows)) and numbers.tolist() == [n for x in rows for n in x]


def test_no_row_of_an_index_is_made_of_single_postings(spark):
    """What is shuffled is a row for each term and block of a task's documents; a document's rows, in several tasks or nulls, come together."""
    docs = spark.createDataFrame([(i // 2, "a b a") for i in range(400)] + [(None, "a"), (None, "c")], "doc_id long, text string").repartition(3)
    shuffled = index._numbered(docs).where("doc is not null").mapInArrow(index._found(True), "term string, block long, data binary")
    assert shuffled.count() == 6
    assert rows_of(index.read(index.build(docs))) == sorted(((t, d, n) for t, n in (("a", 4), ("b", 2)) for d in range(200)), key=repr)
    assert ("a", None, 1) in rows_of(index.postings(docs)) and index.postings(docs).count() == 402
    assert rows_of(index.read(index.build(docs, only=("b",)))) == sorted((("b", d, 2) for d in range(200)), key=repr)
