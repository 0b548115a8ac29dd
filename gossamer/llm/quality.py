"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every hashed word has a fixed sparse random index vector; a word's own vector is the sum of the index vectors
of its neighbours over the whole corpus. A document is the mean of its words' unit vectors. A network with one
hidden layer, trained in numpy on a bounded sample of labelled documents, gives a logit, which a temperature
fitted on documents set aside from the sample turns into a calibrated probability. The vector table has
BUCKETS rows whatever the corpus, so it may be broadcast.

Defined results: a null or empty text has a zero vector, and so the score that the network gives to it; repeated
rows score alike; without both label values in the sample every score is the share of good labels (0.5 with
none); a label that is null is no label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, WINDOW, SPARSE = 4096, 48, 2, 2
#: Labelled rows that the network is fitted on at most, a fixed bound at every corpus size.
SAMPLE = 6000
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 128, 0.01


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, SPARSE dimensions and their signs."""
    rng = np.random.RandomState(11)
    return rng.randint(0, DIM, (SPARSE, BUCKETS)), rng.choice([-1.0, 1.0], (SPARSE, BUCKETS))


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    _, h, _, cut = common.tokens(*common.buffers(part.column("text")), kinds=common.RUNS, lower=False)
    return (h % np.uint64(BUCKETS)).astype(np.int64), cut


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This partition's sum of neighbours' index vectors for each bucket."""
    dim, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for part in common.slices(batch):
            w, cut = _words(part)
            doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            for off in range(1, WINDOW + 1):
                same = doc[off:] == doc[:-off]
                a, b = w[:-off][same], w[off:][same]
                for x, y in ((a, b), (b, a)):
                    for k in range(SPARSE):
                        total += np.bincount(x * DIM + dim[k][y], weights=sign[k][y], minlength=BUCKETS * DIM)
    rows = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(np.abs(rows).any(axis=1))
    yield pa.record_batch([pa.array(used), *(pa.array(rows[used, k]) for k in range(DIM))], names=["bucket", *(f"v{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit vectors, from the whole corpus."""
    schema = "bucket long, " + ", ".join(f"v{k} double" for k in range(DIM))
    sums = docs.select("text").mapInArrow(_contexts, schema).groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))
    table = sums.toPandas().to_numpy(np.float64)  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(table):
        v = np.round(table[:, 1:])  # sums of whole numbers, in any order
        out[table[:, 0].astype(int)] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def _pooled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            for part in common.slices(batch, limit=common.SLICE_BYTES // 2):
                w, cut = _words(part)
                n = np.diff(cut)
                out = np.zeros((len(n), DIM), np.float32)
                for k in range(DIM):
                    run_sum = np.concatenate([[0.0], np.cumsum(vectors[w, k], dtype=np.float64)])
                    out[:, k] = (run_sum[cut[1:]] - run_sum[cut[:-1]]) / np.maximum(n, 1)
                yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), DIM).cast(pa.list_(pa.float32()))], names=["doc_id", "row", "pooled"])

    return run


class Network:
    """Two layers on standardised inputs, fitted with Adam; then a temperature on rows set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.RandomState(5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        aside = rng.rand(len(x)) < 0.2
        z = (x - self.mean) / self.scale
        self.w = [rng.randn(x.shape[1], HIDDEN) * (2 / x.shape[1]) ** 0.5, np.zeros(HIDDEN), rng.randn(HIDDEN) * 0.2, np.zeros(1)]
        self._fit(z[~aside], y[~aside], rng)
        self.temperature = 1.0
        if aside.any() and len(set(y[aside])) > 1:
            logit, t = self._logit(z[aside]), y[aside]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, logit / g) - t * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2[0]

    def _fit(self, z: np.ndarray, y: np.ndarray, rng) -> None:
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(z))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                w1, b1, w2, b2 = self.w
                h = np.maximum(z[rows] @ w1 + b1, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[rows]) / len(rows)
                gh = np.outer(g, w2) * (h > 0)
                t += 1
                for i, d in enumerate((z[rows].T @ gh + 1e-4 * w1, gh.sum(axis=0), h.T @ g + 1e-4 * w2, np.array([g.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.frombuffer(batch.column("pooled").flatten().buffers()[1], np.float32)[batch.column("pooled").offsets[0].as_py() :][: len(batch) * DIM] if len(batch) else np.zeros(0, np.float32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(model(x.reshape(-1, DIM).astype(np.float64)), pa.float64())], names=["doc_id", "row", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), score of every row of docs. labels: doc_id, label (0 or 1), only rows that may be learned from.

    Of several texts with one labelled id, the first by its vector is learned from.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    pooled = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").mapInArrow(_pooled(vectors), "doc_id long, row long, pooled array<float>"), "pooled")
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = pooled.join(sample.hint("shuffle_hash"), "doc_id").groupBy("doc_id", "label").agg(F.min("pooled").alias("pooled")).orderBy("doc_id").toPandas()
    y = rows["label"].to_numpy(np.float64)
    if len(set(y)) > 1:
        model = Network(np.stack(rows["pooled"].to_numpy()).astype(np.float64), y)
    else:
        model = Constant(float(y.mean()) if len(y) else 0.5)
    return pooled.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, row long, score double")
