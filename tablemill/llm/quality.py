"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every word bucket has a fixed sparse ternary index vector; a word's vector is the
sum of the index vectors of its neighbours over *all* documents.  The sums are whole numbers, so they
do not depend on the order in which tasks report.  A document is the mean and the spread of its words'
vectors and the mean product of the vectors of adjacent words.  A network with one hidden layer is
fitted on a bounded sample of labelled rows and its logits are divided by a temperature that is fitted
on rows the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Terms, fold, log_sigmoid_loss, sampled_labels, sampled_texts, sigmoid

BUCKETS = 1 << 14
DIMS = 32
MARKS = 2
REACH = 2


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, marks: int = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors, one per bucket, as places and signs of their marks.

    The last row, of no marks, stands for the border of a text.
    """
    rng = np.random.default_rng(7)
    places = np.vstack([rng.integers(0, dims, (buckets, marks)), np.zeros((1, marks), dtype=np.int64)])
    signs = np.vstack([rng.choice([-1.0, 1.0], (buckets, marks)), np.zeros((1, marks))])
    return places, signs


def bordered(place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids in order, with REACH border ids before, between and after the texts."""
    first = np.flatnonzero(np.r_[True, np.diff(place) > 0]) if len(ids) else np.zeros(0, np.int64)
    return np.insert(np.r_[ids, [BUCKETS] * REACH], np.repeat(first, REACH), BUCKETS)


def context_sums(docs: DataFrame) -> DataFrame:
    """(bucket, c0 ... c31): the summed index vectors of the neighbours, over the whole table."""
    names = [f"c{i}" for i in range(DIMS)]

    def sums(batches):
        terms, (places, signs) = Terms(BUCKETS), index_vectors()
        total = np.zeros((BUCKETS + 1) * DIMS)
        for batch in batches:
            for _, _, place, ids in terms.runs(batch["text"]):
                ids = bordered(place, ids)
                cell = ids * DIMS
                for mark in range(MARKS):
                    at, sign = places[ids, mark], signs[ids, mark]
                    for step in range(1, REACH + 1):
                        total += np.bincount(cell[step:] + at[:-step], sign[:-step], len(total))
                        total += np.bincount(cell[:-step] + at[step:], sign[step:], len(total))
        total = total.reshape(BUCKETS + 1, DIMS)
        rows = np.flatnonzero(np.abs(total[:BUCKETS]).sum(axis=1))
        out = pd.DataFrame(total[rows].astype(np.int64), columns=names)
        out.insert(0, "bucket", rows)
        yield out

    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    parts = docs.select("text").mapInPandas(sums, schema)
    return parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors, at most BUCKETS x DIMS numbers whatever the corpus; unseen buckets are zero."""
    rows = context_sums(docs).toPandas()
    out = np.zeros((BUCKETS + 1, DIMS), dtype=np.float64)
    if len(rows):
        out[rows["bucket"].to_numpy()] = rows.drop(columns="bucket").to_numpy(dtype=np.float64)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        seen = np.abs(out).sum(axis=1) > 0
        out[seen] -= out[seen].mean(axis=0)
    return out.astype(np.float32)


def pooled(texts, vectors: np.ndarray, terms: Terms) -> np.ndarray:
    """One row per text: mean, spread and adjacent product of its word vectors; zeros for no words."""
    n, sums = np.zeros((len(texts), 1)), np.zeros((3, len(texts), DIMS))
    for first, count, place, ids in terms.runs(texts):
        bounds = np.searchsorted(place, np.arange(count + 1))
        every = vectors[ids]
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), first):
            if b > a:
                own = every[a:b]
                n[i] += b - a
                sums[0, i] += own.sum(axis=0)
                sums[1, i] += np.einsum("ij,ij->j", own, own)
                sums[2, i] += np.einsum("ij,ij->j", own[:-1], own[1:])
    mean, square = sums[0] / np.maximum(n, 1), sums[1] / np.maximum(n, 1)
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), sums[2] / np.maximum(n - 1, 1)])


@dataclass
class Network:
    """Scaled input, one tanh layer, one logit, one temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 0.01) -> Network:
    """Adam on three quarters of the rows, the temperature on the last quarter.

    Without rows of both kinds every score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(11)
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    width = x.shape[1]
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden),
                  float(np.log(prior / (1 - prior))))
    if len(set(y.tolist())) < 2:
        return net
    order = rng.permutation(len(y))
    held, rows = order[: len(order) // 4], order[len(order) // 4 :]
    net.mean, net.scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    net.w1 = rng.normal(0, 1 / np.sqrt(width), (width, hidden))
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 128):
            part = rows[at : at + 128]
            h = np.tanh(z[part] @ weights[0] + weights[1])
            error = (sigmoid(h @ weights[2] + weights[3][0]) - y[part]) / len(part)
            back = np.outer(error, weights[2]) * (1 - h * h)
            slopes = [z[part].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(held):
        logits = net.logits(x[held])
        choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))
        net.temperature = float(min(choices, key=lambda t: log_sigmoid_loss(logits / t, y[held])))
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 5, held: int = 0,
                   most_labels: int = 12_000) -> DataFrame:
    """Every column of ``docs`` and held_out boolean, score double, predicted int (1: good).

    Rows of fold ``held`` (crc32 of the id modulo ``parts``) are never learned from.  ``most_labels``
    bounds the labelled sample that reaches the driver, one text for each id (the one of the least
    hash); word vectors come from all documents.  A null or empty text is the zero vector and gets the
    network's score for it.  Repeated rows are scored each, equal texts alike; columns of ``docs`` with one of the three result names are replaced; without usable labels
    every score is 0.5; an empty table gives an empty table.
    """
    vectors = word_vectors(docs)
    sample = sampled_labels(labels, "quality", fold("doc_id", parts) != held, most_labels)

    def features(batches):
        terms = Terms(BUCKETS)
        for batch in batches:
            x = pooled(batch["text"].tolist(), vectors, terms)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": list(x)})

    # at most about most_labels small rows: safe to broadcast and to bring to the driver
    known = (
        sampled_texts(docs, sample)
        .mapInPandas(features, "doc_id long, y int, x array<double>")
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    x = np.array(known["x"].tolist(), dtype=np.float64).reshape(len(known), 3 * DIMS)
    net = fit_network(x, known["y"].to_numpy(dtype=np.float64))
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(BUCKETS)
        for batch in batches:
            yield pd.Series(net.score(pooled(batch.tolist(), vectors, terms)))

    return (
        plain.withColumn("held_out", fold("doc_id", parts) == held)
        .withColumn("score", score(F.col("text")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )

