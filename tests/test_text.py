import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import vint
from millrace.functions.text import bigrams, line_words, prefix, snippet, tokens
from millrace.operators import bigrams as big
from millrace.operators import cooccurrence, counts

from .conftest import rows_of


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def by_hand(text):
    return [w for w in (re.sub(r"^[^a-z]+|[^a-z]+$", "", t.lower()) for t in re.split(r"[ \t\n\r\f]+", text)) if w]


@pytest.mark.parametrize("text, want", [("Father's", ["father's"]), ("--Hello!!", ["hello"]), ("123", []), ("a1b", ["a1b"]), ("École", ["cole"]), ("", []), ("x y z", ["x y", "z"]), (None, []), ("a\tb\x0cc\x0bd", ["a", "b", "c\x0bd"])])
def test_tokens(spark, text, want):
    assert frame(spark, [text]).select(tokens(F.col("line"))).head()[0] == want


def test_tokens_of_random_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abZ9 '-\té\n.") for _ in range(r.randrange(60))) for _ in range(300)]
    got = [x[0] for x in frame(spark, texts).select(tokens(F.col("line"))).collect()]
    assert got == [by_hand(t) for t in texts]


def test_prefix(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abc",)], "w string")
    assert [x[0] for x in df.select(prefix(F.col("w"))).collect()] == ["a", "ab", "ab"]


def test_first_hundred(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    got = frame(spark, ["x " * 100 + "y", "1 " * 50 + " ".join(words)]).select(line_words(F.col("line"))).collect()
    assert got[0][0] == ["x"] and got[1][0] == words


def test_snippet(spark):
    df = spark.createDataFrame([("a" * 80,), ("é" * 81,), (None,)], "t string")
    assert [x[0] for x in df.select(snippet(F.col("t"))).collect()] == ["a" * 80, "é" * 80 + "...", None]


def test_bigrams_stay_within_lines(spark):
    df = frame(spark, ["one", "a b a", "", "b"])
    assert df.select(F.size(bigrams(tokens(F.col("line"))))).collect()[0][0] == 0
    assert rows_of(big.pairs(df)) == [("a", "*", 1.0), ("a", "b", 1.0), ("b", "*", 1.0), ("b", "a", 1.0)]


def test_relative_frequencies_sum_to_one(spark):
    df = frame(spark, ["a b c a b d", "a c", "b d b d"])
    for row in big.relative_frequencies(df).groupBy("left").agg(F.sum("value").alias("s")).collect():
        assert abs(row["s"] - 1) < 1e-12
    stripes = {r["left"]: r["stripe"] for r in big.stripes(df).collect()}
    assert stripes["a"] == pytest.approx({"b": 2 / 3, "c": 1 / 3})


def test_pmi_threshold_and_symmetry(spark):
    df = frame(spark, ["p q"] * 10 + ["r s"] * 9 + ["p 1", "", "7"])
    got = {(r["x"], r["y"]): r["pmi"] for r in cooccurrence.pmi_pairs(df).collect()}
    import math

    assert set(got) == {("p", "q"), ("q", "p")}
    assert got["p", "q"] == got["q", "p"] == pytest.approx(math.log10(10 / (11 * 10) * 20))
    stripes = {r["word"]: r["stripe"] for r in cooccurrence.pmi_stripes(df).collect()}
    assert {(x, y) for x, s in stripes.items() for y in s} == set(got)


def test_counts(spark):
    df = frame(spark, ["The the cat", "", "12", "a"])
    assert rows_of(counts.word_count(df)) == [("a", 1), ("cat", 1), ("the", 2)]
    assert rows_of(counts.prefix_count(df)) == [("a", 1), ("ca", 1), ("th", 2)]
    assert rows_of(counts.line_total(df)) == [(2,)]
    assert rows_of(counts.line_frequency(df, least=1)) == [("a", 1), ("cat", 1), ("the", 1)]


def test_empty_input(spark):
    df = frame(spark, [])
    assert not rows_of(counts.word_count(df)) and not rows_of(big.pairs(df)) and not rows_of(cooccurrence.pmi_pairs(df))


@pytest.mark.parametrize("n, size", [(0, 1), (127, 1), (128, 2), (255, 2), (256, 3), (2**31 - 1, 5), (-112, 1), (-113, 2), (-(2**31), 5), (2**40, 7)])
def test_vint_sizes(n, size):
    assert len(vint.encode([n])) == size and vint.decode(vint.encode([n])) == [n]


def test_vint_round_trip():
    r = random.Random(5)
    numbers = [r.randrange(-(2 ** r.randrange(1, 63)), 2 ** r.randrange(1, 63)) for _ in range(2000)]
    assert vint.decode(vint.encode(numbers)) == numbers
    assert vint.encode([]) == b"" and vint.decode(b"") == []


def test_pmi_is_the_same_by_either_join(spark, monkeypatch):
    """Frequent words are broadcast up to a size, beyond it joined by a shuffle."""
    lines = spark.createDataFrame([(" ".join(f"w{(i * k) % 13}x" for k in range(1, 6)),) for i in range(200)] + [("",), (None,)], "line string")
    told = rows_of(cooccurrence.pmi_pairs(lines))
    monkeypatch.setattr(cooccurrence, "BROADCAST_BYTES", -1)
    assert told == rows_of(cooccurrence.pmi_pairs(lines)) and told
