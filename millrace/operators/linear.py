"""Linear classifiers: logistic regression by one sequential pass of gradient steps, and scoring by one or several models.

A step depends on all before it, so a model's rows go through one task, in order; that task streams them from Spark's
external sort and holds the weights only. What scales out is the number of models (an ensemble's are trained side by side).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import tallied
from ..functions.vint import decode_each, encode_each
from ..functions.words import octets, slices
from ..session import kept

DELTA = 0.002
#: Features that a task looks at at once.
FEATURES = 200_000


def descend(instances: Iterator[tuple[int, list[tuple[int, int]]]], delta: float = DELTA) -> dict[int, float]:
    """Weights after one pass over (y, [(feature, times)]); a repeated feature counts and is updated at each occurrence."""
    w: dict[int, float] = {}
    for y, n in instances:
        score = sum(w.get(f, 0.0) * k for f, k in n)
        gradient = y - (1 / (1 + math.exp(-score)) if score > -700 else 0.0)
        for f, k in n:
            w[f] = w.get(f, 0.0) + gradient * delta * k
    return w


def portions(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, the rows' sizes and the features without nulls of so many rows of a list column as have FEATURES in all."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + FEATURES, side="right")) - 1)
        flat = column.slice(i, j - i).flatten()
        row, good = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), flat.is_valid().to_numpy(zero_copy_only=False)
        yield i, np.bincount(row[good], minlength=j - i), flat.drop_null().to_numpy().astype(np.int64)
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, of features, becomes bytes: of each distinct feature in order the step from the one before, and its times."""
    for b in batches:
        for i, size, f in portions(b.columns[-1]):
            row, low = np.repeat(np.arange(len(size)), size), -(1 << 31)
            keys, times = tallied(row << 32 | f - low)
            row, f = keys >> 32, (keys & 0xFFFFFFFF) + low
            step = np.diff(f, prepend=0)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            step[first] = f[first]
            data, bytes_of = encode_each(np.stack((step, times), axis=1).ravel())
            ends = np.concatenate(([0], np.cumsum(bytes_of)))[2 * np.searchsorted(row, np.arange(len(size) + 1))]
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, len(size)) for c in b.columns[:-1]), packed], b.schema.names)


def train(instances: DataFrame, order: str = "docid", delta: float = DELTA, shuffle_seed: int | None = None, model: str | None = None) -> DataFrame:
    """(feature, weight), or (model_id, feature, weight) if `model` names a column: one model for each of its values.

    instances: (docid, label, features); label `spam` is 1, any other 0. Rows go in order of `order`, or of a seeded hash of
    it. Null features have no effect.
    """
    key = F.col(order) if shuffle_seed is None else F.xxhash64(F.lit(shuffle_seed), F.col(order))
    # what is shuffled and sorted are packed counts, as one task reads all of a model's
    rows = instances.select(F.lit(0).alias("m") if model is None else F.col(model).cast("int").alias("m"), key.alias("k"), F.col(order).alias("o"), (F.col("label") == "spam").cast("int").alias("y"), F.col("features").cast("array<int>").alias("f"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    rows = rows.mapInArrow(_counted, kinds + ", f binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def instances() -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
            for b in (p for x in batches for p in slices(x, 2, 1 << 16)):
                numbers, size = decode_each(*octets(b.column(2)))
                ends = np.concatenate(([0], np.cumsum(size)))
                for m, y, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends[:-1], ends[1:]):
                    yield m, y, list(zip(np.cumsum(numbers[i:j:2]).tolist(), numbers[i + 1 : j : 2].tolist()))

        def done(m: int, own: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m] * len(own), pa.int32()), pa.array([f for f, _ in own], pa.int32()), pa.array([x for _, x in own], pa.float64())], ["model_id", "feature", "weight"])

        rest = instances()
        row = next(rest, None)
        while row is not None:
            m = row[0]

            def own() -> Iterator[tuple[int, list[tuple[int, int]]]]:
                nonlocal row
                while row is not None and row[0] == m:
                    yield row[1] or 0, row[2]
                    row = next(rest, None)

            yield done(m, sorted(descend(own(), delta).items()))

    # models are dealt to tasks; within a task they lie one after the other, each in its order
    dealt = rows.repartition(1) if model is None else rows.repartition("m")
    out = dealt.sortWithinPartitions("m", "k", "o", "y").select("m", "y", "f").mapInArrow(run, "model_id int, feature int, weight double")
    return out.drop("model_id") if model is None else out


#: Weights up to which models are broadcast to where the instances lie, 16 bytes each; beyond, features are joined by a shuffle.
BROADCAST_WEIGHTS = 200_000


def last_wins(models: DataFrame, *keys: str) -> DataFrame:
    """One weight for each of the keys: of repeated ones that with the greatest `at`, where there is such a column; otherwise
    which one of them is not defined, as rows of a table have no order."""
    order = "at" if "at" in models.columns else "weight"
    return models.groupBy(*keys).agg(F.max_by("weight", order).alias("weight"))


def _sums(instances: DataFrame, models: DataFrame, order: list[int]) -> DataFrame:
    """(docid, label, s0, s1, ...): a row for each instance, with the sum of its features' weights in each model of `order`.

    Each occurrence of a feature counts, unknown ones count 0. models: (model_id, feature, weight), no feature twice in one.
    Instances stay where they lie if the weights are few enough to be told to all tasks; otherwise each gets a number, by which
    its sums come together again, so instances that share a docid never do.
    """
    names = [f"s{i}" for i in range(len(order))]
    few = models.limit(BROADCAST_WEIGHTS + 1).collect()
    if len(few) <= BROADCAST_WEIGHTS:
        place = {m: i for i, m in enumerate(order)}
        known = np.unique(np.array([r["feature"] for r in few if r["feature"] is not None], np.int64))
        table = np.zeros((len(order), len(known) + 1))  # the last place is that of unknown features
        for r in few:
            if r["model_id"] in place and r["feature"] is not None:
                table[place[r["model_id"]], np.searchsorted(known, r["feature"])] = r["weight"] or 0.0
        told = instances.sparkSession.sparkContext.broadcast((known, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, table = told.value
            for b in batches:
                for i, size, f in portions(b.column(2)):
                    at = np.searchsorted(known, f)
                    at[np.append(known, 0)[at] != f] = len(known)
                    ends = np.concatenate(([0], np.cumsum(size))).tolist()
                    sums = [pa.array([math.fsum(w[at[j:k]].tolist()) for j, k in zip(ends, ends[1:])], pa.float64()) for w in table]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(size)), b.column(1).slice(i, len(size)), *sums], ["docid", "label", *names])

        kind = instances.schema["docid"].dataType.simpleString()
        return instances.select("docid", F.col("label").cast("string").alias("label"), F.col("features").cast("array<int>").alias("features")).mapInArrow(run, f"docid {kind}, label string, " + ", ".join(f"{n} double" for n in names))
    by_feature = models.groupBy("feature").agg(*(F.max(F.when(F.col("model_id") == m, F.col("weight"))).alias(f"w{i}") for i, m in enumerate(order)))
    # numbers of rows are made once and written down, as a row that is computed again could get another one
    counted = kept(instances.select("docid", "label", F.monotonically_increasing_id().alias("row"), "features")).select("docid", "label", "row", F.explode_outer("features").alias("feature"))
    return counted.join(by_feature, "feature", "left").groupBy("row").agg(F.first("docid").alias("docid"), F.first("label").alias("label"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(n) for i, n in enumerate(names))).drop("row")


def scores(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(docid, label, score) for each instance, rows that share a docid too."""
    return _sums(instances, last_wins(model, "feature").withColumn("model_id", F.lit(0)), [0]).withColumnRenamed("s0", "score")


def apply(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(docid, label, score, prediction): `spam` for a score above 0, else `ham`."""
    return scores(instances, model).withColumn("prediction", F.when(F.col("score") > 0, "spam").otherwise("ham"))


def ensemble(instances: DataFrame, models: DataFrame, method: str = "average", digits: int = 9) -> DataFrame:
    """(docid, label, score, prediction) by several models (model_id, feature, weight).

    `average`: the mean of the models' scores. `vote`: models with a score above 0 less the others; scores within half of
    10^-digits of 0 are taken for 0, which float sums in another order are. Any other method, or no models, raises ValueError.
    A row for each instance; of a feature that a model repeats, the last weight counts (by `at`, as readers give it).
    """
    if method not in ("average", "vote"):
        raise ValueError(f"unknown method {method!r}: average or vote")
    order = [r[0] for r in models.select("model_id").distinct().orderBy("model_id").collect()]
    if not order:
        raise ValueError("no models")
    n = len(order)
    found = _sums(instances, last_wins(models, "model_id", "feature"), order)
    each = [F.col(f"s{i}") for i in range(n)]
    if method == "average":
        score = sum(each[1:], each[0]) / F.lit(float(n))
    else:
        spam = sum((F.when(F.round(s, digits) > 0, 1).otherwise(0) for s in each[1:]), F.when(F.round(each[0], digits) > 0, 1).otherwise(0))
        score = (2 * spam - F.lit(n)).cast("double")
    return found.select("docid", "label", score.alias("score")).withColumn("prediction", F.when(F.round("score", digits) > 0, "spam").otherwise("ham"))
