"""Toxicity by a factorization machine over hashed terms (operator 10).

A document is the set of its hashed terms, and of those that it repeats. Terms are words and their beginnings of BEGINNINGS
bytes, so that other forms of a word, not seen in training, count too. The machine adds a weight for each term and the
product of two terms' factors for each pair, so a pair such as an insult and whom it is aimed at counts for more (or
less) than its parts. Terms are the buckets that tell the labels apart best in the training sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit

TRAIN_ROWS, BUCKETS, TERMS, FACTORS = 12_000, 1 << 22, 256, 6
BEGINNINGS = (4, 5, 6, 8)
LEAST_DOCUMENTS = 3


def _terms(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets of a text's terms, and of those that stand there twice or more (the upper half)."""
    ids, counts = np.unique(hashes[hashes > 0] % np.uint64(BUCKETS), return_counts=True)
    return np.concatenate((ids, ids[counts > 1] + np.uint64(BUCKETS))).astype(np.int64)


def _documents(column: pa.Array):
    data, offsets = kit.text_buffers(column)
    for first, last, hashes, bounds in kit.word_hashes(data, offsets, kit.ALNUM, BEGINNINGS):
        for r in range(first, last):
            yield hashes[bounds[r - first] : bounds[r - first + 1]]


@dataclass
class Machine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, documents) -> np.ndarray:
        """0 or 1 for each of documents (arrays of buckets) and term."""
        x = np.zeros((len(documents), len(self.terms)), np.float32)
        if len(self.terms):
            for r, ids in enumerate(documents):
                at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
                x[r, at[self.terms[at] == ids]] = 1
        return x

    def logit(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (summed**2 - (x * x) @ self.factors**2).sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def train(terms: np.ndarray, documents: list[np.ndarray], y: np.ndarray, steps: int = 1200, rate: float = 0.02, decay: float = 3e-4, seed: int = 5) -> Machine:
    random = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    own = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), random.normal(0, 0.1, (len(terms), FACTORS)))
    if not len(y) or not len(terms):
        return own
    x = own.rows(documents)
    values = [np.array([own.bias]), own.weights, own.factors]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, steps + 1):
        pick = random.integers(0, len(y), 512)
        part = x[pick]
        own.bias, own.weights, own.factors = float(values[0][0]), values[1], values[2]
        error = (own.probability(part) - y[pick]) / len(pick)
        summed = part @ own.factors
        slope = part.T @ (error[:, None] * summed) - ((part * part).T @ error)[:, None] * own.factors
        for i, g in enumerate((error.sum(keepdims=True), part.T @ error + decay * values[1], slope + decay * values[2])):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    own.bias, own.weights, own.factors = float(values[0][0]), values[1], values[2]
    return own


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learns from the texts and labels of about rows labelled documents outside the held-out bucket.

    Rows without a label, an id or a text of theirs teach nothing; of several labels of an id the largest counts, of several
    texts one by hash. Without any, all texts score 0.5. Other columns are ignored.
    """
    kit.small_batches(documents.sparkSession)
    chosen = kit.labelled_sample(labels, "toxic", 5, 0, rows)
    sample = kit.one_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "label")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([_terms(h) for h in _documents(batch.column("text"))], pa.list_(pa.int64()))], schema=schema)

    hashed = kit.cut(sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, ids array<bigint>"))
    size, bad = hashed.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    by_term = hashed.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.sum("label").alias("b")).filter(F.col("n") >= LEAST_DOCUMENTS)
    expected = F.col("n") * F.lit(bad / max(1, size))
    surprise = (F.col("b") - expected) * (F.col("b") - expected) / F.greatest(expected, F.lit(1e-6))
    terms = np.sort(np.array([r["id"] for r in by_term.orderBy(surprise.desc(), "id").limit(TERMS).collect()], np.int64))
    kept = F.filter("ids", lambda i: F.array_contains(F.lit(terms.tolist()) if len(terms) else F.array().cast("array<bigint>"), i))
    made = hashed.select("doc_id", "label", kept.alias("ids")).toPandas().sort_values("doc_id")
    return train(terms, [np.asarray(i, np.int64) for i in made["ids"]], made["label"].to_numpy(np.float64))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row. Null texts score as empty ones. Each row is scored by its text alone, so repeated rows
    and ids are scored alike, ties too; an empty table gives none."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        own = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pandas()
            x = own.rows([_terms(h) for h in _documents(batch.column("text"))])
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": ids, "score": own.probability(x)}), preserve_index=False)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = kit.table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, kit.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", kit.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
