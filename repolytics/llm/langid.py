"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the character n-grams (one to four letters, with word boundaries) of the
lower-cased letter runs of a text, hashed into a fixed number of buckets.  Counting runs
over every training row in Spark; what reaches the driver is the matrix of counts,
languages x buckets, whatever the corpus.  The log-probability matrix is broadcast.  A
batch of texts is scored as a sparse product: the buckets of all its positions are looked
up in the matrix column by column and summed over each text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repolytics.llm import chargrams
from repolytics.llm.common import held_out, worker_object

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
MOST_LANGUAGES = 512
UNKNOWN = "und"


@dataclass
class Model:
    """languages (sorted), log-probabilities (languages x buckets, bucket 0 void), log-priors."""

    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray


def _counts(buckets: int, most_languages: int):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                by: dict[str, list] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    if lang not in sums:
                        if len(sums) == most_languages:
                            raise ValueError(f"more than {most_languages} languages")
                        sums[lang] = np.zeros(buckets, np.int64)
                    for parts, _ in chargrams.pieces(texts):
                        points, _ = chargrams.laid_out(parts, "letters", True)
                        for n in ORDERS:
                            sums[lang] += np.bincount(chargrams.grams(points, n, buckets), minlength=buckets)
        for lang, counts in sums.items():
            counts[0] = 0
            keys = np.flatnonzero(counts)
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int32)), pa.array(counts[part])], ["lang", "bucket", "n"])

    return run


def train(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.1) -> Model:
    """Fit on all rows of docs (text, lang) where neither is null."""
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    sums = known.mapInArrow(_counts(buckets, MOST_LANGUAGES), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["c"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}
    languages = sorted(totals)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix is meant for at most {MOST_LANGUAGES}")
    logp = np.zeros((len(languages), buckets), np.float32)
    if languages:
        found = sums.toArrow()
        names, cells, n = found.column("lang").combine_chunks().dictionary_encode(), found.column("bucket").to_numpy(), found.column("n").to_numpy()
        at = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
        codes = names.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(languages):  # one language's counts at a time
            own, part = np.full(buckets, smoothing), codes == at.get(name, -1)
            own[cells[part]] += n[part]
            logp[i] = np.log(own) - np.log(own.sum())
            logp[i, 0] = 0
    prior = np.log(np.array([totals[x] for x in languages], float) / max(1, sum(totals.values()))) if languages else np.zeros(0)
    return Model(languages, logp, prior)


def score(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, posterior probability) of each text; (und, 0) where it has no letters."""
    totals, found = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for parts, owners in chargrams.pieces(texts):
        points, starts = chargrams.laid_out(parts, "letters", True)
        np.add.at(found, owners, np.add.reduceat(points > 0, starts, dtype=np.int64))
        for n in ORDERS:
            at = chargrams.grams(points, n, model.logp.shape[1])
            for i, column in enumerate(model.logp):
                np.add.at(totals[:, i], owners, np.add.reduceat(column.take(at), starts, dtype=np.float64))
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    logs = totals + model.prior
    best = np.argmax(logs, axis=1)
    shares = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [(model.languages[b], float(s)) if f else (UNKNOWN, 0.0) for b, s, f in zip(best.tolist(), shares.tolist(), found.tolist())]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row.

    Null texts and texts without letters are `und` with score 0, as is every text where
    nothing could be learnt (an empty training table).  Ties go to the first language in
    order; repeated rows get the same answer each; a null doc_id stays null; further
    columns of docs are not looked at.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        known = worker_object(key, lambda: shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = score(known, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows outside the held-out fold."""
    model = train(docs.filter(~held_out("doc_id", fold)))
    return predict(docs, model).select("doc_id", held_out("doc_id", fold).alias("held_out"), "lang_pred", "score")
