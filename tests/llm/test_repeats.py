"""Removal of repeated byte strings over several slices and buckets, and how many rows it shuffles."""

import hashlib

import numpy as np
import pytest

from gossamer.llm import bwt_dedup


def prose(rng, n: int) -> str:
    return " ".join("".join(rng.choice(list("abcdefghéл"), rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text) of some 3 MB: a line of all, passages of pairs and parts of them, copies, equal and null ids, and a text longer than a slice."""
    rng = np.random.RandomState(8)
    line, passages = prose(rng, 25), [prose(rng, 60) for _ in range(20)]
    out = []
    for k in range(700):
        p = passages[k % 20]
        cut = rng.randint(0, len(p) // 2)
        out.append((1000 - k, f"{prose(rng, 150)} {line}{p[cut : cut + rng.randint(40, 200)]} {prose(rng, 150)}"))
    out += [(2000 + k, out[0][1]) for k in range(30)]
    out += [(5, prose(rng, 40) + line), (5, line + prose(rng, 40)), (5, line), (None, line), (None, None), (6, None), (7, ""), (8, line[:49]), (9, line[:50])]
    return out + [(3000, prose(rng, 60_000) + passages[3] * 2 + out[40][1]), (1, passages[3] + "xyz" * 40)]


def shuffled(spark) -> int:
    """Rows that stages have written to shuffles in this session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def expected(rows):
    raw, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, b in raw:
        for j in range(len(b) - 49) if d is not None else ():
            w = b[j : j + 50]
            first[w] = min(d, first.get(w, d))
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49) if d is not None else ():
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


key = lambda x: (x[0] is None, x[0] or 0, *x[1:])


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 1 << 17])
def test_slices_and_buckets(spark, rows, monkeypatch, bucket_bytes):
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", bucket_bytes)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = shuffled(spark)
    got = [tuple(r) for r in bwt_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    # rows are parcels of a slice's records; a row for each anchor would be over 150,000
    assert shuffled(spark) - before < 5_000


def test_spans_of_texts(spark, rows):
    """Spans that go, of the texts that have some, cover the bytes that go."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((d, n) for d, _, n, _, _ in expected(rows) if n)
    got = [(r["doc_id"], len({k for s in r["spans"] for k in range(s >> 7, (s >> 7) + (s & 127))})) for r in bwt_dedup.repeated_spans(docs).collect()]
    assert sorted(got) == want


def test_a_passage_of_all_sends_two_records_a_slice(spark):
    """However many documents have an anchor, a context, a window or a string, a slice sends one or two records of it."""
    import pyarrow as pa

    line = ("all of them have this line of text, which is longer than any window of it by far, " * 2)[:120]
    texts = [f"{chr(97 + k % 26)}{k}" + line + f"{k}{chr(97 + k % 26)}" for k in range(400)]
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (np.arange(400), cuts)]
    batch = pa.record_batch([pa.array([0]), *lists, pa.array(["".join(texts).encode()], pa.binary())], names=["slice", "docs", "cuts", "data"])
    anchors = bwt_dedup._Anchors(batch, 0, 8)
    assert len(anchors.h) > 2000 and np.unique(anchors.records[:, 0], return_counts=True)[1].max() <= 2


def test_anchors_are_dealt_evenly():
    """Anchors are the smallest hashes of their windows, so buckets can't be ranges of them."""
    data = np.frombuffer(prose(np.random.RandomState(3), 20_000).encode(), np.uint8)
    h, *_ = bwt_dedup.anchors(data, np.array([0, len(data)]))
    counts = np.bincount(bwt_dedup._dealt(h, 16)[1], minlength=16)
    assert len(h) > 5_000 and counts.max() < 1.3 * counts.mean()
