"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words and their first four and five bytes, hashed into TERMS cells, each present or not.
The ACTIVE terms whose presence differs most between toxic and other documents of the labelled sample, of those that differ by SIGNIFICANT standard errors, are active. A factorization machine over
them adds to the linear weights a low-rank weight for every pair of active terms that occur together, so a pair
can count for more, or less, than its terms by themselves. It is trained in numpy with Adagrad; the sample is
stratified, and scores are shifted back to the share of toxic labels among all that may be learned from.

Defined results: a null or empty text has no term and scores as the bias; terms count once in a text; repeated rows
score alike; without both label values every score is the share of toxic labels (0.5 with none); a null label is no
label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TERMS, PREFIXES = 1 << 18, (None, 4, 5)
#: Labelled rows that the machine is fitted on at most: toxic and others. Fixed bounds at every corpus size.
SAMPLE = (3000, 6000)
#: Bytes of their term lists at most.
SAMPLE_BYTES = 48 << 20
ACTIVE, RANK, EPOCHS, BATCH, RATE = 1024, 6, 30, 64, 0.1
#: Differences in presence of fewer standard errors are left out.
SIGNIFICANT = 4.0


def _terms(part: pa.RecordBatch, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and term of each term that a document has, once each, in order; only active ones if given."""
    data, offsets = common.buffers(part.column("text"))
    codes = []
    for k, prefix in enumerate(PREFIXES):
        _, h, size, cut = common.tokens(data, offsets, kinds=common.RUNS, prefix=prefix)
        term = (h * np.uint64(2 * k + 1) >> np.uint64(40)).astype(np.int64) % TERMS
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        keep = size > prefix if prefix else np.ones(len(size), bool)
        if active is not None:
            keep &= active[term]
        codes.append(doc[keep] * TERMS + term[keep])
    code = np.unique(np.concatenate(codes))
    return code // TERMS, code % TERMS


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            doc, term = _terms(part)
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            lists = [term[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int64()), pa.array(lists, pa.binary())], names=["doc_id", "label", "terms"])


class FactorizationMachine:
    """logit = b + sum w_i + sum over pairs <v_i, v_j>, over the active terms present."""

    def __init__(self, term_lists: list[np.ndarray], y: np.ndarray, shift: float = 0.0):
        present = np.concatenate(term_lists) if term_lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(term_lists)), [len(t) for t in term_lists])
        n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        toxic = np.bincount(present, weights=y[owner], minlength=TERMS)
        both = np.bincount(present, minlength=TERMS)
        p1, p0, p = toxic / n1, (both - toxic) / n0, both / (n1 + n0)
        z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        chosen = np.argsort(-np.abs(z), kind="stable")[:ACTIVE]
        chosen = chosen[np.abs(z[chosen]) >= SIGNIFICANT]
        self.place = np.full(TERMS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        rng = np.random.RandomState(3)
        self.b, self.w, self.v = 0.0, np.zeros(len(chosen) + 1), np.append(rng.randn(len(chosen), RANK) * 0.05, np.zeros((1, RANK)), axis=0)
        keep = self.place[present] >= 0
        self._fit(owner[keep], self.place[present[keep]], y, rng)
        self.b += shift

    @property
    def active(self) -> np.ndarray:
        return self.place >= 0

    def logit(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(doc, weights=self.w[at], minlength=n)
        pairs = np.zeros(n)
        for k in range(RANK):
            v = self.v[at, k]
            pairs += np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n)
        return self.b + linear + pairs / 2

    def _fit(self, owner: np.ndarray, at: np.ndarray, y: np.ndarray, rng) -> None:
        cut = np.searchsorted(owner, np.arange(len(y) + 1))
        hw, hv, hb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                size = cut[rows + 1] - cut[rows]
                doc = np.repeat(np.arange(len(rows)), size)
                i = at[np.repeat(cut[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                g = (1 / (1 + np.exp(-np.clip(self.logit(doc, i, len(rows)), -30, 30))) - y[rows]) / len(rows)
                hb += g.sum() ** 2
                self.b -= RATE * g.sum() / hb**0.5
                if not len(i):
                    continue
                total = np.zeros((len(rows), RANK))
                np.add.at(total, doc, self.v[i])
                used, back = np.unique(i, return_inverse=True)
                gw, gv = np.zeros(len(used)), np.zeros((len(used), RANK))
                np.add.at(gw, back, g[doc])
                np.add.at(gv, back, g[doc, None] * (total[doc] - self.v[i]))
                gw += 1e-5 * self.w[used]
                gv += 1e-4 * self.v[used]
                hw[used] += gw**2
                hv[used] += gv**2
                self.w[used] -= RATE * gw / np.sqrt(hw[used])
                self.v[used] -= 0.3 * RATE * gv / np.sqrt(hv[used])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in common.slices(batch):
                if isinstance(model, float):
                    p = np.full(len(part), model)
                else:
                    doc, term = _terms(part, model.active)
                    p = 1 / (1 + np.exp(-np.clip(model.logit(doc, model.place[term], len(part)), -30, 30)))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every row of docs. labels: doc_id, label (0 or 1), only rows that may be learned from."""
    spark = docs.sparkSession
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    count = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        model = float(min(count)) if count else 0.5
    else:
        parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, SAMPLE[0]), (0, SAMPLE[1]))]
        sample = parts[0].unionByName(parts[1])  # at most sum(SAMPLE) rows, so it may be broadcast
        texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        rows = texts.mapInArrow(_term_lists, "doc_id long, label long, terms binary").groupBy("doc_id", "label").agg(F.min("terms").alias("terms"))
        # whole rows in a fixed order, up to a bound in bytes: what the driver gets doesn't grow with the texts
        held = F.sum(F.octet_length("terms") + 64).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        rows = rows.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).drop("held").orderBy("doc_id").toPandas()
        y = rows["label"].to_numpy(np.float64)
        # of the rows that came: labels may be without a document, and the bound in bytes may have cut
        drawn = [int((y == k).sum()) for k in (1, 0)]
        if min(drawn) == 0:
            model = count[1] / (count[0] + count[1])
        else:
            shift = float(np.log(count[1] / drawn[0]) - np.log(count[0] / drawn[1]))
            model = FactorizationMachine([np.frombuffer(t, "<u4").astype(np.int64) for t in rows["terms"]], y, shift)
    return docs.select("doc_id", "text").mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, score double")
