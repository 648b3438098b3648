"""Toxicity by a classifier chain of linear models.

The chain predicts the label categories one after the other (here: low quality, then toxic). Each link is a logistic
regression over word features and over the log-odds of the categories before it. In training these come out of fold: each
of `FOLDS` models predicts the documents it wasn't trained on, so a later link learns from predictions as uncertain as it
will meet. Folds go by the text's hash, so exact copies never part. The features of a link are those whose chi-squared
with its label is above `CHI2`, found on the training folds alone; the cut for a category is the one with the best F1 on
its out-of-fold predictions.

Features of a text: its lower-case words, their first four and five letters, and runs of two or more signs; present or not,
of the whole text. The models are fitted on a bounded sample of labelled documents, `SAMPLE` of them by the hash of
doc_id. The driver gets the features of at least `LEAST` of these that pass the chi-squared test of some link or fold, all
of them; the counts for it are summed by the tasks. Every document is scored, where it lies, without a shuffle.

Nulls and edges: a null or empty text has no features and is scored by the models' constants. Labels that are null, or
whose doc_id is null or missing among the documents, are not used; of several rows of a doc_id one is. Without labelled
documents, or with those of one kind only, the category's probability is the smoothed share of positive labels, and
nothing is rejected. Repeated rows each get their own row. Empty tables give no rows. Extra columns pass `reject` unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, packed, unpacked

SAMPLE, LEAST, FOLDS, CHI2, PENALTY = 8000, 4, 5, 24.0, 1.0
#: Category and the SQL condition on a row of labels that makes it positive.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")


def features(text: str | None) -> set[str]:
    words = set(TOKEN.findall((text or "").lower()))
    return words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """A 0/1 matrix by rows: row i holds columns[starts[i]:starts[i + 1]]; and a few dense columns."""

    def __init__(self, lists: list[np.ndarray], width: int, dense: np.ndarray):
        self.n, self.width, self.dense = len(lists), width, dense
        self.columns = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])

    def times(self, w: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, w[self.columns], self.n) if len(self.columns) else np.zeros(self.n)
        return sparse + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.columns, r[self.row], self.width) if len(self.columns) else np.zeros(self.width)
        return np.concatenate((sparse, self.dense.T @ r))


def logistic(x: Rows, y: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by L-BFGS; the last dense column is the constant, not penalised."""
    free = np.ones(x.width + x.dense.shape[1])
    free[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.times(w), -35, 35)
        return float((np.logaddexp(0, z) - y * z).sum() + penalty / 2 * (free * w * w).sum()), x.back(sigmoid(z) - y) + penalty * free * w

    w = np.zeros(len(free))
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, tail = -g, []
        for s, t, rho in reversed(past):
            a = rho * (s @ d)
            tail.append(a)
            d = d - a * t
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, t, rho), a in zip(past, reversed(tail)):
            d = d + s * (a - rho * (t @ d))
        step, slope = 1.0, float(g @ d)
        while (new := loss(w + step * d))[0] > f + 1e-4 * step * slope and step > 1e-8:
            step /= 2
        s, t = step * d, new[1] - g
        w, (f, g), old = w + s, new, f
        if (c := float(s @ t)) > 1e-12:
            past = [*past[-9:], (s, t, 1 / c)]
        if old - f < 1e-7 * max(1.0, abs(f)):
            break
    return w


@dataclass
class Link:
    """A category's model: weights by feature, of the log-odds of earlier categories, a constant, and the cut."""

    category: str
    weights: dict[str, float]
    earlier: list[float]
    constant: float
    cut: float


def chosen(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """The columns whose chi-squared with y is at least CHI2."""
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        return np.zeros(0, np.int64)
    at, owner = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(n), [len(x) for x in rows])
    df, both = np.bincount(at, minlength=width).astype(float), np.bincount(at, y[owner].astype(float), width)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (both * n - df * positive) ** 2 / (df * (n - df) * positive * (n - positive))
    return np.flatnonzero(np.nan_to_num(chi2) >= CHI2)


def fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, their weights, dense weights with the constant last)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.02
        return np.zeros(0, np.int64), np.zeros(0), np.concatenate((np.zeros(earlier.shape[1]), [np.log(share / (1 - share))]))
    columns = chosen(rows, y, width)
    at = np.full(width, -1)
    at[columns] = np.arange(len(columns))
    w = logistic(Rows([at[r][at[r] >= 0] for r in rows], len(columns), np.hstack((earlier, np.ones((len(y), 1))))), y)
    return columns, w[: len(columns)], w[len(columns) :]


def log_odds(model: tuple, rows: list[np.ndarray], earlier: np.ndarray, width: int) -> np.ndarray:
    columns, w, dense = model
    full = np.zeros(width + 1)
    full[columns] = w
    return np.array([full[r].sum() for r in rows]) + np.hstack((earlier, np.ones((len(rows), 1)))) @ dense if rows else np.zeros(0)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a positive prediction has the best F1; above 1 if there is nothing to tell apart."""
    if not len(y) or y.min() == y.max():
        return 1.1
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities aren't parted
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else p[i])) / 2)


def chain(vocabulary: list[str], rows: list[np.ndarray], fold: np.ndarray, labels: np.ndarray, categories: list[str]) -> list[Link]:
    """Fits the links in order; labels has a column per category. Out-of-fold log-odds of each feed those after it."""
    links, width = [], len(vocabulary)
    earlier = np.zeros((len(rows), 0))
    for j, category in enumerate(categories):
        y, odds = labels[:, j].astype(float), np.zeros(len(rows))
        for k in range(FOLDS):
            inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = fit([rows[i] for i in inside], y[inside], earlier[inside], width)
            odds[out] = log_odds(model, [rows[i] for i in out], earlier[out], width)
        columns, w, dense = fit(rows, y, earlier, width)
        links.append(Link(category, {vocabulary[c]: float(x) for c, x in zip(columns, w)}, dense[:-1].tolist(), float(dense[-1]), best_cut(sigmoid(odds), y)))
        earlier = np.hstack((earlier, np.clip(odds, -35, 35)[:, None]))
    return links


def telling(one: DataFrame, names: list[str]) -> list[str]:
    """The features of at least LEAST rows of one (fold, y0, ..., f) that have a chi-squared of CHI2 in what some fold's or the
    final model of some category is trained on. Only these can get a weight."""
    kinds = range(len(names))
    sums = [F.count("*").alias("n"), *(F.sum(f"y{j}").alias(f"y{j}") for j in kinds)]
    of = {r["fold"]: r for r in one.groupBy("fold").agg(*sums).collect()}
    own = [F.count("*").alias("n")]
    for k in range(FOLDS):
        here = F.col("fold") == k
        own += [F.count_if(here).alias(f"n_{k}"), *(F.count_if(here & (F.col(f"y{j}") == 1)).alias(f"y{j}_{k}") for j in kinds)]
    words = one.select("fold", *(f"y{j}" for j in kinds), F.explode("f").alias("w")).groupBy("w").agg(*own).where(F.col("n") >= LEAST)
    tests = []
    for out in range(-1, FOLDS):  # -1: all folds
        inside = [k for k in range(FOLDS) if k != out]
        n = float(sum(of[k]["n"] for k in inside if k in of))
        df = sum((F.col(f"n_{k}") for k in inside), F.lit(0.0))
        for j in kinds:
            positive = float(sum(of[k][f"y{j}"] for k in inside if k in of))
            if 0 < positive < n:
                both = sum((F.col(f"y{j}_{k}") for k in inside), F.lit(0.0))
                # `chosen` tests again: what differs here by rounding mustn't be lost
                tests.append(n * (both * n - df * positive) ** 2 >= (CHI2 - 1e-6) * df * (n - df) * positive * (n - positive))
    if not tests:
        return []
    found = words.where(reduce(or_, tests)).select("w", "n")
    return [r["w"] for r in found.orderBy(F.desc("n"), "w").collect()]


def train(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, sample: int = SAMPLE) -> list[Link]:
    """The chain from a bounded sample of labelled documents; the driver gets numbers of vocabulary entries, not texts."""
    names = [c for c, _ in categories]
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), *(F.expr(condition).cast("int").alias(f"y{j}") for j, (_, condition) in enumerate(categories)))
    y = y.dropna().groupBy("doc_id").agg(*(F.max(f"y{j}").alias(f"y{j}") for j in range(len(names))))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # labels without a document don't count: of the documents' ids only those that are labelled are taken
    have = y.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = texts.join(F.broadcast(have), "doc_id")  # `sample` rows of a few numbers

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(f=[sorted(features(t)) for t in b["text"]])[["doc_id", "fold", *(f"y{j}" for j in range(len(names))), "f"]]

    found = picked.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")).mapInPandas(cut, "doc_id long, fold int, " + "".join(f"y{j} int, " for j in range(len(names))) + "f array<string>")
    # of repeated rows of a doc_id one is used; which one doesn't depend on tasks
    one = kept(found.groupBy("doc_id").agg(F.min(F.struct(*found.columns[1:])).alias("x")).select("doc_id", "x.*"))
    vocabulary = telling(one, names)
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = number.value
        for b in batches:
            ids = pa.array([[at[w] for w in f if w in at] for f in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], b.schema.names)

    table = one.mapInArrow(numbers, one.schema.simpleString()[7:-1].replace(":", " ").replace("array<string>", "array<int>")).toPandas().sort_values("doc_id")
    table = table.assign(f=[np.asarray(x, np.int64) for x in table["f"]])
    return chain(vocabulary, list(table["f"]), table["fold"].to_numpy(), table[[f"y{j}" for j in range(len(names))]].to_numpy().reshape(-1, len(names)), names)


def score(links: list[Link], text: str | None) -> list[float]:
    """The categories' probabilities, each link fed with those before it."""
    f, odds = features(text), []
    for link in links:
        w = link.weights
        z = link.constant + sum(w[x] for x in sorted(f & w.keys())) + sum(a * b for a, b in zip(link.earlier, odds))
        odds.append(float(np.clip(z, -35, 35)))
    return sigmoid(np.array(odds)).tolist()


def classify(docs: DataFrame, links: list[Link]) -> DataFrame:
    """doc_id, a probability and a 0/1 decision per category, for each row of docs (doc_id, text)."""
    names, model = [x.category for x in links], docs.sparkSession.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            p = np.array([score(own, t.as_py()) for t in b.column(1)]).reshape(-1, len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(len(own))), *(pa.array((p[:, j] >= x.cut).astype(np.int32)) for j, x in enumerate(own))], ["doc_id", *(f"p_{n}" for n in names), *names])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"p_{n} double" for n in names), *(f"{n} int" for n in names)]))


def reject(docs: DataFrame, links: list[Link], category: str = "toxic") -> DataFrame:
    """docs without the rows that the category's link rejects, all columns kept."""
    model, j = docs.sparkSession.sparkContext.broadcast(links), [x.category for x in links].index(category)

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series([score(own[: j + 1], t)[j] >= own[j].cut for t in text], dtype=bool)

    return packed(docs).where(~rejected(F.col("d.text"))).select(*unpacked(docs.columns))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
