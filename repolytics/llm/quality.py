"""Quality classifier: supervised subword embeddings, averaged and classified by softmax.

A text's features are its words and their character n-grams (two to four, with word
boundaries), each hashed to a row of a matrix of learnt vectors; a word that equals the
word before it adds one further feature.  A document is the mean of all its
features' vectors, and a softmax layer gives the class probabilities.  Both layers are
trained by plain numpy stochastic gradient descent on the driver, from a bounded sample
of labelled rows whose hashed features the executors prepare.

Scoring is linear up to the softmax, so the two layers fold into one logit for each
bucket, which is summed over the features of a batch of texts in numpy; the result is
the same.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from repolytics.llm import chargrams
from repolytics.llm.common import held_out, worker_object

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIM = 16
MOST_TRAIN = 4000
REPEAT = 1  # the bucket of "equals the word before it"; bucket 0 is void


def features(parts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The features of texts laid end to end.

    Gives where each text starts, for each order the bucket at every position (0: none),
    and for the words their places, buckets and whether they repeat the word before.
    """
    points, starts = chargrams.laid_out(parts, "visible", False)
    orders = [chargrams.grams(points, n, buckets) for n in ORDERS]
    places, hashes = chargrams.words(points)
    owner = np.searchsorted(starts, places, side="right")
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.zeros(0, bool)
    named = np.maximum((hashes >> np.uint64(40)) & np.uint64(buckets - 1), np.uint64(2)).astype(np.int32)
    return starts, orders, places, named, again


@dataclass
class Model:
    """vectors (buckets x dim), weights (dim x 2), bias (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def counts_of(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of the features of one text."""
    total = np.zeros(buckets, np.int64)
    for parts, _ in chargrams.pieces([text]):
        _, orders, _, named, again = features(parts, buckets)
        for found in [*orders, named]:
            total += np.bincount(found, minlength=buckets)
        total[REPEAT] += again.sum()
    total[0] = 0
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.float32)


def _sparse(buckets: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [counts_of(t, buckets) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary()), part.column(3)], ["doc_id", "label", "ids", "counts", "times"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 1, most: int = MOST_TRAIN, buckets: int = BUCKETS) -> list[tuple]:
    """(label, ids, counts) of at most `most` labelled rows outside the held-out fold.

    Rows are chosen by a hash of doc_id; of several labels of one doc_id the largest counts.
    Each row that repeats a doc_id trains by its own text, and `most` bounds rows, not ids:
    where rows repeat ids, those of the first ids and then of the smallest text hash train.
    The chosen ids are bounded, so they are broadcast; rows are cut by hashes of their texts,
    and of equal rows one text is shuffled and counts as often as the row occurs.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out("doc_id", fold))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    cut = texts.select("doc_id", "text_key").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(most)
    times = cut.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    once = texts.join(F.broadcast(times), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(*(F.first(c).alias(c) for c in ("label", "text", "times")))
    found = once.select("doc_id", "label", "text", "times").mapInArrow(_sparse(buckets), "doc_id long, label int, ids binary, counts binary, times long").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in found.columns)))
    return [(label, np.frombuffer(ids, np.int32), np.frombuffer(counts, np.float32)) for _, label, ids, counts, n in rows for _ in range(n)]


def fit(rows: list[tuple], dim: int = DIM, buckets: int = BUCKETS, epochs: int = 10, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over shuffled rows, the rate falling linearly to zero.

    Classes are weighted to count alike.  Without rows of both classes the model answers
    the one class there is (or one half where there is none).
    """
    random = np.random.default_rng(seed)
    vectors = (random.random((buckets, dim), np.float32) - 0.5) / dim
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    tally = np.bincount([r[0] for r in rows], minlength=2)[:2] if rows else np.zeros(2)
    if (tally == 0).any():
        bias[:] = np.sign(tally - tally[::-1]) * 5
        return Model(vectors, weights, bias)
    balance = np.sqrt(len(rows) / (2 * tally))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            label, ids, counts = rows[k]
            now = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                hidden = np.zeros(dim, np.float32)
            else:
                share = counts / counts.sum()
                hidden = share @ vectors[ids]
            logits = hidden @ weights + bias
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            wrong = prob * balance[label]
            wrong[label] -= balance[label]
            back = weights @ wrong
            weights -= now * np.outer(hidden, wrong)
            bias -= now * 0.1 * wrong
            if len(ids):
                vectors[ids] -= (now * len(ids) ** 0.5) * share[:, None] * back
    return Model(vectors, weights.astype(np.float32), bias.astype(np.float32))


class Scorer:
    """The layers of a model folded into one logit for each bucket."""

    def __init__(self, model: Model):
        self.logit = (model.vectors @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float64)
        self.logit[0] = 0
        self.bias = float(model.bias[1] - model.bias[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text; without words, what the bias alone says."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for parts, owners in chargrams.pieces(texts):
            starts, orders, places, named, again = features(parts, len(self.logit))
            for at in orders:
                np.add.at(total, owners, np.add.reduceat(self.logit.take(at), starts))
                np.add.at(n, owners, np.add.reduceat(at > 0, starts, dtype=np.int64))
            of = owners[np.searchsorted(starts, places, side="right") - 1]
            total += np.bincount(of, self.logit[named] + again * self.logit[REPEAT], len(texts))
            n += np.bincount(of, 1 + again, len(texts))
        z = self.bias + np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1) of every row, from its whole text.

    Null and empty texts score by the bias alone; repeated rows score alike; a null
    doc_id stays null; an empty table gives an empty result; further columns of docs are
    not looked at.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = worker_object(key, lambda: Scorer(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 1, most: int = MOST_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.5); learnt outside the fold."""
    model = fit(training_rows(docs, labels, label, fold, most))
    scored = predict(docs, model)
    return scored.select("doc_id", held_out("doc_id", fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored_rows(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """docs with one further column, the score of predict(); no join, rows stay as they are."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    docs = docs.drop(column)
    kept = docs.columns

    def run(batches):
        scorer = worker_object(key, lambda: Scorer(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = pa.array(scorer.scores(part.column(kept.index("text")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*kept, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
