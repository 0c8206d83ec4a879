"""Toxicity: cumulative-link ordinal regression over sparse word features, giving the expected severity of each document.

Grades come from the labels alone: 0 a document that isn't toxic, 1 a toxic one, 2 a toxic one that is of bad quality too (a null quality is not bad, nor is
that of labels without such a column). P(grade <= k) = sigmoid(theta_k - w.x): the thresholds
theta are ordered and share the weights w. x says which of the kept words a whole text holds. The expected severity is sum_k P(grade > k).

Only the fit uses a sample: at most `max_train` labelled documents, those with the smallest hash of doc_id, and of each the one text of the smallest hash; that bounds
what reaches the driver: the words of the sample that are kept, and their numbers by document. Scoring reads every word of every text, without a shuffle.

Defined results: a null or empty text has no words, so the severity of the thresholds alone; null labels and labels without a document take
no part in the fit; repeated rows are scored alike, each on its own; with no labels of either class every severity is 0 and nothing
is rejected; an empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, change_rows, map_columns

GRADES = 3
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The features of a text: its words, and the beginnings (PREFIXES characters and "~") of those that go on, as insults are compounded and inflected."""
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    return words.union(*({f"{w[:k]}~" for w in words if len(w) > k} for k in PREFIXES))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str | None) -> tuple[float, float]:
        """Expected severity, and the probability of any grade above 0."""
        if not self.thresholds:
            return 0.0, 0.0
        # in order of the words: the same sum wherever it is made
        x = sum(self.weights[w] for w in sorted(words_of(text) & self.weights.keys()))
        above = [1 / (1 + math.exp(min(700.0, max(-700.0, t - x)))) for t in self.thresholds]
        return sum(above), above[0]


def loss_and_gradient(p: np.ndarray, cols: np.ndarray, at: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its penalty, and its gradient. p: weights, then theta_0, then logarithms of the gaps between thresholds. cols and at: the
    features and the row of each of them; y: the grades."""
    n, n_features = max(1, len(y)), len(p) - GRADES + 1
    gaps = np.exp(p[n_features + 1 :])
    theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
    x = np.bincount(at, p[cols], minlength=len(y)) if len(cols) else np.zeros(len(y))
    cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - x[:, None], -60, 60)))
    full = np.concatenate([np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))], axis=1)
    dens = np.concatenate([np.zeros((len(y), 1)), cdf * (1 - cdf), np.zeros((len(y), 1))], axis=1)
    r = np.arange(len(y))
    prob = np.maximum(full[r, y + 1] - full[r, y], 1e-12)
    up, low = dens[r, y + 1] / prob, dens[r, y] / prob
    g = np.zeros_like(p)
    if len(cols):
        g[:n_features] = np.bincount(cols, ((up - low) / n)[at], minlength=n_features)
    strength = l2 / math.sqrt(n)
    g[:n_features] += strength * p[:n_features]
    dtheta = np.array([(np.where(y == k + 1, low, 0).sum() - np.where(y == k, up, 0).sum()) / n for k in range(GRADES - 1)])
    g[n_features] = dtheta.sum()
    g[n_features + 1 :] = [dtheta[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]
    return float(-np.log(prob).sum() / n + strength / 2 * (p[:n_features] ** 2).sum()), g


def fit_ordinal(features: pa.ListArray, grades: np.ndarray, n_features: int, steps: int = 1500, rate: float = 0.1, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood, by Adam. theta_0 is free and each further threshold lies exp(d) above the one before, so that they stay ordered."""
    y, cols = np.asarray(grades, np.int64), features.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(y)), features.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    p = np.zeros(n_features + GRADES - 1)
    p[n_features] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(p, cols, at, y, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, least: int = 4, z: float = 6.0) -> Model:
    """Fits on the labelled documents of the sample. Kept words: in at least `least` of them, and in toxic ones more or less often than chance by z standard errors."""
    bad = F.coalesce(F.col("quality").cast("int") == 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    graded = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"), bad.alias("bad")).where("doc_id is not null and toxic in (0, 1)")
    # a doc_id with several labels has the least of them; broadcast: max_train rows of two numbers
    sample = graded.groupBy("doc_id").agg(F.min(F.expr("toxic + int(toxic = 1 and bad)")).alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    # a doc_id that repeats counts once, summed up in each task first; a null text only where there is no other
    one = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("h"), "text")).alias("one"))
    texts = one.select("doc_id", "grade", "one.text")

    def start():
        return lambda cols: {"doc_id": cols["doc_id"], "grade": cols["grade"], "words": [sorted(words_of(t)) for t in cols["text"]]}

    work = Workspace(docs.sparkSession)
    seen = work.table(map_columns(texts, "doc_id long, grade int, words array<string>", start), "toxicity-sample")
    toxic = F.col("grade") > 0
    neg, pos = seen.agg(F.count_if(~toxic), F.count_if(toxic)).first()
    if not pos or not neg:
        work.drop()
        return Model({}, ())
    rate = pos / (pos + neg)
    counts = seen.select(toxic.cast("int").alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= least)
    score = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = sorted(counts.where(F.abs(score) >= z).select("word").toArrow()["word"].to_pylist())
    index = {w: k for k, w in enumerate(kept)}

    def number():
        return lambda cols: {"doc_id": cols["doc_id"], "grade": cols["grade"], "features": [[index[w] for w in words if w in index] for words in cols["words"]]}

    # max_train rows of numbers of kept words
    held = map_columns(seen, "doc_id long, grade int, features array<int>", number).toArrow().sort_by("doc_id")
    work.drop()
    w, theta = fit_ordinal(held["features"].combine_chunks(), held["grade"].to_numpy(), len(kept))
    return Model({word: float(w[k]) for word, k in index.items()}, tuple(map(float, theta)))


SCHEMA = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: expected severity, probability of any toxicity, the nearest grade, and whether it is rejected."""

    def start():
        def apply(cols):
            both = [model.severity(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "severity": [s for s, _ in both], "p_toxic": [p for _, p in both], "grade": [int(s + 0.5) for s, _ in both], "toxic": [p >= threshold for _, p in both]}

        return apply

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), SCHEMA, start)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that the model does not reject."""
    at = docs.columns.index("text")

    def start():
        return lambda rows: rows.filter(pa.array([model.severity(t)[1] < threshold for t in rows.column(at).to_pylist()], pa.bool_()))

    return change_rows(docs, start)
