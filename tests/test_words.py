import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import words as W
from millrace.functions.text import tokens
from millrace.operators import cooccurrence

TEXTS = ["", "a", "--Hello!!", "x\x0by z", "123", "Kelvin İx", "ΑΣ bÉb", "end", "start ", " 9", "\n\n", "a1bü c"]


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words_are_the_tokens(spark, most):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("abZ9 '-\téÉ\n\x0b\rİ.") for _ in range(r.randrange(60))) for _ in range(300)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")), W.lowered(F.col("t"))).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["t"]).slice(1)
    got = []
    for part in W.slices(batch, most=most):
        flat, sizes = W.words(part.column(0))
        flat = iter(flat.to_pylist())
        got += [[next(flat) for _ in range(n)] for n in sizes]
    assert got == [r[0] for r in rows][1:]
    assert W.words(pa.array([], pa.string()))[0].to_pylist() == []


@pytest.mark.parametrize("pairs, held, block", [(3, 5, 7), (50, 40, 100), (10**6, 10**6, 10**6)])
@pytest.mark.parametrize("buckets, bits", [(1, 2), (3, 20), (11, 28)])
def test_blocks_of_any_size_give_all_pairs(monkeypatch, pairs, held, block, buckets, bits):
    """Counts are made by blocks of words and summed by buckets, no pair is a row; words that fill parts, and counts over the bits for them."""
    for name, value in (("PAIRS", pairs), ("HELD", held), ("BLOCK", block), ("COUNT_BITS", bits)):
        monkeypatch.setattr(cooccurrence, name, value)
    r = random.Random(pairs + buckets)
    lines = [sorted(r.sample(range(11), r.randrange(9))) for _ in range(80)]
    want = Counter(p for x in lines for p in combinations(x, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(lines[i : i + 9], pa.list_(pa.int64()))], ["ids"]) for i in range(0, 80, 9)]
    given = pa.Table.from_batches(cooccurrence._count(11, buckets, None)(iter(batches))).sort_by("bucket")
    summed = pa.Table.from_batches(cooccurrence._sum(11, buckets, 4)(iter(given.to_batches(4))))
    assert {(x["a"], x["b"]): x["cnt"] for x in summed.to_pylist()} == {p: n for p, n in want.items() if n >= 4}
    assert summed.num_rows == len({(x["a"], x["b"]) for x in summed.to_pylist()})


def test_pairs_of_whole_lines(spark):
    """Words after a line's hundredth token count; the first hundred only where that is asked for."""
    far = spark.createDataFrame([("x " * 120 + "y",)] * 10, "line string")
    assert {(r["x"], r["y"], r["cnt"]) for r in cooccurrence.pmi_pairs(far).collect()} == {("x", "y", 10), ("y", "x", 10)}
    assert cooccurrence.pmi_pairs(far, most=100).count() == 0


def test_bigrams_are_counted_where_lines_are_read(spark):
    """A task's repeated bigrams leave it as one row, and tables of counts are made after the shuffle, none before."""
    from millrace.operators import bigrams

    lines = spark.createDataFrame([("a b a b",), ("",), ("b",), (None,), ("c",)] * 50, "line string").coalesce(1)
    rows = lines.select(W.lowered(F.col("line")).alias("line")).mapInArrow(bigrams._neighbours, "left string, right string, cnt long").collect()
    assert sorted(map(tuple, rows)) == [("a", "b", 100), ("b", "a", 50)]
    plan = bigrams.counts(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("MapInArrow")
    assert sorted(map(tuple, bigrams.counts(lines).collect())) == [("a", "b", 100), ("b", "a", 50)]
