"""Quality classifier (operator 6): random-indexing word vectors, pooled, and a two-layer network in numpy.

Every word, symbol run and word shape has a sparse ternary index vector seeded by its hash bucket. A word's vector adds
the index vectors of its neighbours over the training sample (random indexing). A document pools the mean vector of each
kind, the mean product of adjacent words' vectors (repetition shows there) and a few magnitudes. The network's
probabilities are calibrated by a temperature fitted on rows it was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm import kit

TRAIN_ROWS = 12_000
PIECE = kit.CHUNK_BYTES // 2  # words; runs of several texts hold no more
DIMENSIONS, WORDS, SYMBOLS, SHAPES, REACH, HIDDEN = 32, 1 << 14, 1 << 10, 1 << 9, 2, 32

#: Byte tables of the other two kinds: runs of ASCII punctuation; case patterns, other word bytes alike.
_PUNCTUATION = np.array([b + 1 if 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E else 0 for b in range(256)], np.uint64)
_SHAPE = np.array([1 if 0x41 <= b <= 0x5A else 2 if 0x61 <= b <= 0x7A or b >= 0x80 else 3 if 0x30 <= b <= 0x39 else 0 for b in range(256)], np.uint64)
_KINDS = ((kit.ALNUM, WORDS), (_PUNCTUATION, SYMBOLS), (_SHAPE, SHAPES))


def index_vectors(seed: int, buckets: int) -> np.ndarray:
    """Four entries of +1 or -1 in each vector."""
    random = np.random.default_rng(seed)
    out = np.zeros((buckets, DIMENSIONS), np.float32)
    place = random.permuted(np.tile(np.arange(DIMENSIONS), (buckets, 1)), axis=1)[:, :4]
    np.put_along_axis(out, place, random.choice(np.array([-1, 1], np.float32), (buckets, 4)), axis=1)
    return out


INDEX = [index_vectors(7 + k, buckets) for k, (_, buckets) in enumerate(_KINDS)]


def _token_runs(column: pa.Array, kind: int):
    data, offsets = kit.text_buffers(column)
    to, buckets = _KINDS[kind]
    for first, last, hashes, bounds in kit.word_hashes(data, offsets, to):
        yield first, last, (hashes % np.uint64(buckets)).astype(np.int64), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the rows of values in each of bounds."""
    total = np.zeros((len(bounds) - 1, values.shape[1]), np.float32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return total


def _pool(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of its words' vectors and of the products of adjacent ones.

    A text of more than PIECE words, which is a run of its own, is summed in pieces: memory doesn't grow with it.
    """
    if len(ids) > PIECE:
        total = np.zeros((2, table.shape[1]))
        for a in range(0, len(ids), PIECE):
            own = table[ids[a : a + PIECE + 1]]
            total += own[:PIECE].sum(axis=0, dtype=np.float64), (own[:-1] * own[1:]).sum(axis=0, dtype=np.float64)
        return total[:1].astype(np.float32), total[1:].astype(np.float32)
    own = table[ids]
    product = np.zeros_like(own)
    product[:-1] = own[:-1] * own[1:]
    product[bounds[1:][np.diff(bounds) > 0] - 1] = 0  # the last word of a text has no follower
    return _sums(own, bounds), _sums(product, bounds)


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of pooled values for each text, of whole texts; zeros where there are no words."""
    kinds = []
    for kind in range(3):
        table = vectors if kind == 0 else INDEX[kind]
        pooled, counts, beside = [], [], []
        for _, _, ids, bounds in _token_runs(column, kind):
            total, products = _pool(table, ids, bounds)
            pooled.append(total)
            counts.append(np.diff(bounds))
            beside.append(products)
        n = np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.float32)[:, None]
        kinds.append((np.concatenate(pooled or [np.zeros((0, DIMENSIONS), np.float32)]) / np.maximum(n, 1), n))
        if kind == 0:
            adjacent = np.concatenate(beside or [np.zeros((0, DIMENSIONS), np.float32)]) / np.maximum(n, 1)
    norm = lambda m: np.linalg.norm(m, axis=1, keepdims=True)
    ratio = kinds[1][1] / np.maximum(kinds[0][1], 1)
    return np.hstack([m for m, _ in kinds] + [adjacent, adjacent.sum(axis=1, keepdims=True), norm(kinds[0][0]), norm(kinds[1][0]), norm(kinds[2][0]), ratio, np.log1p(kinds[0][1]) / 10, np.log1p(kinds[1][1]) / 10]).astype(np.float32)


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Index vector plus the unit sum of neighbours' index vectors, for each word bucket. At most 8 tasks send a table each."""
    schema = pa.schema([("part", pa.binary())])

    def run(batches):
        total = np.zeros((WORDS, DIMENSIONS))
        for batch in batches:
            for _, _, ids, bounds in _token_runs(batch.column("text"), 0):
                own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, REACH + 1):
                    near = own[step:] == own[:-step]
                    a, b = ids[:-step][near], ids[step:][near]
                    for d in range(DIMENSIONS):
                        column = INDEX[0][:, d]
                        total[:, d] += np.bincount(a, column[b], WORDS) + np.bincount(b, column[a], WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    parts = sample.select("text").coalesce(8).mapInArrow(run, "part binary").collect()
    total = sum((np.frombuffer(r["part"], np.float32).reshape(WORDS, DIMENSIONS) for r in parts), np.zeros((WORDS, DIMENSIONS), np.float32))
    return (INDEX[0] + 2 * total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on log loss over four fifths of the rows; the temperature is fitted on the last fifth."""
    if not len(x):
        return Network(0.0, 1.0, np.zeros((3 * DIMENSIONS + DIMENSIONS + 7, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    kept, own = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[own].mean(axis=0), x[own].std(axis=0) + 1e-4, random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.2, HIDDEN), 0.0)
    z = np.clip((x - net.mean) / net.spread, -8, 8)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, steps + 1):
        rows = own[random.integers(0, len(own), 256)]
        hidden = np.maximum(z[rows] @ values[0] + values[1], 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30))) - y[rows]) / len(rows)
        back = np.outer(error, values[2]) * (hidden > 0)
        for i, g in enumerate((z[rows].T @ back + decay * values[0], back.sum(axis=0), hidden.T @ error + decay * values[2], error.sum(keepdims=True))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if len(kept):
        logit = net.logit(x[kept])
        loss = lambda c: np.mean(np.logaddexp(0, np.where(y[kept] > 0.5, -1, 1) * logit / c))
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Vectors and network from the texts and labels of about rows labelled documents outside the held-out bucket.

    Rows without a label, an id or a text of theirs teach nothing; of several labels of an id the largest counts, of several
    texts one by hash. Without any, all texts score 0.5. Other columns are ignored.
    """
    kit.small_batches(documents.sparkSession)
    chosen = kit.labelled_sample(labels, "quality", 3, 1, rows)
    sample = kit.cut(kit.one_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "label"))
    vectors = word_vectors(sample)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], schema=schema)

    made = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, x array<float>").toPandas().sort_values("doc_id")
    x = np.array(made["x"].tolist(), np.float64) if len(made) else np.zeros((0, 1))
    return vectors, train(x, made["label"].to_numpy(np.float64))


def score(documents: DataFrame, model: tuple[np.ndarray, Network], name: str = "quality_score") -> DataFrame:
    """All columns of documents and the score, which takes the place of a column of its name.

    Null texts score as empty ones. Each row is scored by its text alone, so repeated rows and ids are scored alike, ties
    too; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kit.small_batches(documents.sparkSession)
    documents = documents.drop(name)
    numbered = [f"c{i}" for i in range(len(documents.columns))]  # mapInArrow can't take a name with a backtick
    text = numbered[[c.lower() for c in documents.columns].index("text")]
    plain = documents.select(*(c.alias(n) for c, n in zip(kit.own(documents), numbered, strict=True)))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            parts = [net.probability(features(batch.column(text).slice(a, 512), vectors)) for a in range(0, batch.num_rows, 512)]
            yield batch.append_column("score", pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    return plain.mapInArrow(run, schema).toDF(*documents.columns, name)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = kit.table(spark, sf_dir, "documents")
    model = fit(documents, kit.table(spark, sf_dir, "labels"))
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", kit.held_out(3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
