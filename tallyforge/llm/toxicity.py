"""Toxicity scores by non-negative positive-unlabelled learning of a linear model over word presence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_unit, materialize, small_side

WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(words(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of f(x) = x.w + b that minimise the non-negative risk

        prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

    with the logistic loss l. Where the corrected negative part is below zero, a step raises it again instead of lowering the risk.
    """
    w, b = np.zeros(x_pos.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        f_pos, f_unl = x_pos @ w + b, x_unl @ w + b
        s_pos, s_unl = sigmoid(f_pos) / len(f_pos), sigmoid(f_unl) / len(f_unl)
        negative = np.logaddexp(0, f_unl).mean() - prior * np.logaddexp(0, f_pos).mean()
        down_pos = prior * (s_pos - 1 / len(f_pos))
        g_pos, g_unl = -prior * s_pos, s_unl
        parts = (down_pos + g_pos, g_unl) if negative >= 0 else (-g_pos, -g_unl)
        grad = np.append(x_pos.T @ parts[0] + x_unl.T @ parts[1] + l2 * w, parts[0].sum() + parts[1].sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, positives: int = 3000, unlabelled: int = 6000, n_words: int = 1000, least_errors: float = 4.0) -> Model:
    """Learns from about `positives` documents labelled toxic and `unlabelled` ones without that label, chosen by a hash of doc_id.

    The class prior is the share of label 1 among the labelled rows. Of a document with several labels the highest counts. The n_words
    words whose document shares in the two samples differ most, by least_errors standard errors or more, are the features. Without any positive
    or unlabelled document the model scores the prior (0.5 if there are no labels) everywhere.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    tagged = docs.select("doc_id").join(one, "doc_id", "left").withColumn("positive", F.coalesce("_toxic", F.lit(False)))
    n = tagged.agg(F.count_if("positive"), F.count("_toxic"), F.count_if(~F.col("positive"))).first()
    n_pos, n_labelled, n_rest = (x or 0 for x in n)
    prior = float(np.clip(n_pos / n_labelled, 0.001, 0.999)) if n_labelled else 0.5
    if not n_pos or not n_rest:
        return Model({}, float(np.log(prior / (1 - prior))))
    unit = hash_unit(F.lit("toxicity"), F.col("doc_id"))
    chosen = tagged.where(F.col("doc_id").isNotNull() & (unit < F.when(F.col("positive"), positives / n_pos).otherwise(unlabelled / n_rest)))
    # ids are chosen before texts are read, and as few as the sample has; beyond twice that they aren't broadcast
    ids = small_side(materialize(chosen.select("doc_id", "positive").distinct(), "toxicity-ids"), 2 * (positives + unlabelled))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "positive": pdf["positive"], "words": [sorted(words(t)) for t in pdf["text"]]})

    sample = materialize(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id").select("doc_id", "positive", "text").mapInPandas(split, "doc_id long, positive boolean, words array<string>"), "toxicity-sample")
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = sizes.get(True, 0), sizes.get(False, 0)
    if not a or not b:
        return Model({}, float(np.log(prior / (1 - prior))))
    p1, p0, p = F.col("a") / a, F.col("b") / b, (F.col("a") + F.col("b") + 0.5) / (a + b + 1)
    strength = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / a + 1 / b))
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    vocabulary = [r.word for r in counts.where((F.col("a") + F.col("b") >= 4) & (strength >= least_errors)).orderBy(F.desc(strength), "word").limit(n_words).collect()]
    place = {w: i for i, w in enumerate(vocabulary)}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "positive": pdf["positive"], "at": [[place[w] for w in ws if w in place] for ws in pdf["words"]]})

    rows = sample.mapInPandas(index, "doc_id long, positive boolean, at array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.at))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[r.at] = 1
    positive = np.array([r.positive for r in rows])
    # the unlabelled set stands for all documents: toxic ones join it by the prior
    mixed = np.vstack([x[~positive], x[positive][: int(prior / (1 - prior) * (~positive).sum())]])
    w, bias = fit_nnpu(x[positive], mixed, prior)
    return Model({t: float(v) for t, v in zip(vocabulary, w, strict=True)}, bias)


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text) with score (0 to 1) and predicted, from whole texts. A null or empty text has no words and scores the model's bias.

    Rows are scored one by one; equal texts score alike; an empty table gives an empty result; other columns of docs pass through unread.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([round(model.score(t), 6) for t in s], dtype=float)

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
