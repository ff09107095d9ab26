"""Text quality by positive-unlabelled learning.

Trusted texts are known positives; web text is unlabelled, a mixture of good and bad. A linear model
minimises the non-negative unbiased risk

    prior * E_trusted[loss(g)] + max(0, E_web[loss(-g)] - prior * E_trusted[loss(-g)])

with the logistic loss; while the second term is below zero its gradient is followed upwards, which
keeps the model from driving the risk of the unseen negatives under zero. The prior, the share of
good text on the web, is estimated: a first model tells trusted from web text, and among the
thresholds on its score the least ratio (share of web above) / (share of trusted above) bounds it.

Features come from the text alone: shares of character classes and statistics of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import documents, fold

#: The most documents the model is fitted on, of each kind; all documents are scored.
MAX_TRUSTED, MAX_WEB = 6_000, 12_000
STEPS, RATE, DECAY = 400, 0.05, 0.02

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"-()", "!?", "#$%&*@^~+=<>", "|/\\_[]{}`"]):
    _CLASSES[[ord(c) for c in _chars]] = _k + 1
N_CLASSES = 10
N_WORDS = 5
WIDTH = N_CLASSES + N_WORDS + 1


def features(text: str | None) -> np.ndarray:
    """The features of one text; an empty or null one has only the constant."""
    out = np.zeros(WIDTH, np.float32)
    out[-1] = 1
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out[:N_CLASSES] = np.bincount(_CLASSES[raw], minlength=N_CLASSES) / len(raw)
    words = text.split()
    n = max(len(words), 1)
    lines = text.count("\n") + 1
    out[N_CLASSES:-1] = (
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / math.sqrt(n * 4) if n > 4 else 1,
        min(len(text) / n, 40) / 10,
        math.log1p(n) / 5,
        lines / n,
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _descend(width: int, gradient) -> np.ndarray:
    """Adam on a full batch from zero, so that the result depends on the rows alone."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(trusted: np.ndarray, web: np.ndarray) -> float:
    """The share of positives in ``web``, from scores that tell trusted from web rows.

    Above any threshold the web share is at least prior times the trusted share, so the least ratio
    bounds the prior from above; the slack keeps thin tails from deciding it.
    """
    slack = lambda n: math.sqrt(math.log(20) / (2 * n))
    best = 1.0
    for t in np.quantile(trusted, np.linspace(0, 0.9, 181)):
        above, of = (web >= t).mean(), (trusted >= t).mean()
        best = min(best, (above + slack(len(web))) / of)
    return float(min(max(best - slack(len(web)), 0.05), 0.999))


def fit(trusted: np.ndarray, web: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative risk. Without trusted or web rows every score is a half."""
    width = trusted.shape[1]
    if not len(trusted) or not len(web):
        return Model(np.zeros(width), np.zeros(width), np.ones(width), prior or 0.5)
    both = np.concatenate([trusted, web]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    p, u = (trusted - mean) / scale, (web - mean) / scale
    if prior is None:
        first = _descend(width, lambda w: u.T @ _sigmoid(u @ w) / len(u) - p.T @ _sigmoid(-(p @ w)) / len(p))
        prior = estimated_prior(p @ first, u @ first)

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        positive = -prior * (p.T @ _sigmoid(-gp)) / len(p)
        rest = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return positive + rest if negative_risk >= 0 else -rest

    return Model(_descend(width, gradient), mean, scale, prior)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``MAX_TRUSTED`` trusted and ``MAX_WEB`` web documents of the training fold.

    The sample is taken by the hash of the id, from ids alone; then only its texts are read. A
    document is trusted if all its labels say 1. Ids are bounded by the two parameters.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("trusted"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).distinct()
    ids = ids.join(marks, "doc_id", "left").select("doc_id", F.coalesce(F.col("trusted") == 1, F.lit(False)).alias("trusted"))
    by_hash = lambda own, n: ids.where(own).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash("trusted", MAX_TRUSTED).union(by_hash("NOT trusted", MAX_WEB))
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, trusted boolean")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "trusted": batch["trusted"], "x": rows})

    found = docs.join(F.broadcast(chosen), "doc_id").mapInPandas(extract, "doc_id long, trusted boolean, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, WIDTH)
    own = found["trusted"].to_numpy(dtype=bool)
    return x[own], x[~own]


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(documents(docs), labels))


def _scorer(model: Model):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.stack([features(t) for t in texts])) if len(texts) else [], dtype="float64")

    return F.pandas_udf(score, "double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted``; a null text counts as empty. Columns of
    these names are replaced."""
    return docs.withColumn("score", _scorer(model)("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores a half or more."""
    return docs.where(_scorer(model)("text") >= 0.5)


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``. Labels of the fold 1 of 3 are
    never read; without any label every score is a half. Repeated rows are scored one by one, equal texts
    alike, a score of exactly a half predicts 1, and a text of any length is read whole. An empty table
    gives no row."""
    plain = documents(docs)
    model = learned(plain, labels)
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored(plain, model).select("doc_id", held_out, "score", "predicted")
