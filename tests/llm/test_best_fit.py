import os
import random
import zlib

import numpy as np
import pytest

from gossamer.llm import best_fit, common, queries, token_blocks


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if capacity - b[0] >= n]
        if fitting:
            max(fitting, key=lambda b: b[0])[0] += n
        else:
            bins.append([n])
    return len(bins)


def check(rows, capacity):
    """Every sequence is filled from 0 without gaps and within its capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def table(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], best_fit.PIECES)


def test_bins_are_best_fit():
    rnd = random.Random(1)
    for _ in range(100):
        capacity = rnd.choice([10, 50, 2048])
        lengths = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(0, 120))]
        bins = best_fit.Bins(capacity)
        for n in sorted(lengths, reverse=True):
            bins.put(n)
        assert len(bins.room) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("kind", ["small", "large", "mixed", "sorted", "same"])
def test_hierarchy_comes_near_one_best_fit(spark, kind):
    rnd = random.Random(2)
    n = 1200
    lengths = {
        "small": [rnd.randrange(1, 400) for _ in range(n)],
        "large": [rnd.randrange(1100, 2049) for _ in range(n)],
        "mixed": [rnd.choice([rnd.randrange(1, 60), rnd.randrange(1, 2049), 2048]) for _ in range(n)],
        "sorted": sorted(rnd.randrange(1, 2049) for _ in range(n)),
        "same": [1] * n,
    }[kind]
    rows = best_fit.pack(table(spark, lengths), leaves=20, fan=3).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in rows) == [(i, x, i) for i, x in enumerate(lengths)]
    used, one, least = check(rows, 2048), plain_best_fit(lengths, 2048), -(-sum(lengths) // 2048)
    assert least <= used <= max(one + 20, 1.03 * one)
    if kind in ("small", "same"):
        assert used <= least + max(4, 0.02 * least)


def test_what_is_carried_up_loses_no_merge(spark):
    # bins of 1,100 fill all leaves but one, which has few small ones that each fit behind one of them
    lengths = [1100] * 700 + [900] * 9
    rows = best_fit.pack(table(spark, lengths).coalesce(1), leaves=12, fan=2).collect()
    assert check(rows, 2048) == 700


def test_documents_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_blocks.default_tokenizer())
    rnd = random.Random(4)
    words = ["the", "Straße", "don't", "naïve", "12", "x" * 30, "İ", "é", "!?", "zqxj", "Σς"]
    texts = [None, "", " \n", "one"] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 900))) for _ in range(40)] + ["word " * 2047, "word " * 2048, "word " * 6000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as piece", "1 as bin", "2 as length")
    got = best_fit.packed_documents(docs)
    placed = got.collect()
    check(placed, 2048)
    expected = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(i, k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in placed)
    whole = best_fit.sequences(got, best_fit.pieces(docs, with_ids=True)).collect()
    assert sum(r.n_ids for r in whole) == sum(e[3] for e in expected) and all(r.n_ids <= 2048 for r in whole)
    by_id = {r.sequence_id: r.ids for r in whole}
    for r in placed:
        assert zlib.crc32(np.array(by_id[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32


def test_query_and_empty_table(spark):
    rows = queries.op13_best_fit(spark, "/root/testdata/sf0.001").collect()
    total = sum(r.length for r in rows)
    assert check(rows, 2048) <= 1.02 * total / 2048 + 2
    assert best_fit.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert not [x for x in os.listdir(common.scratch(spark)) if x.startswith(("pieces-", "leaves-", "nodes-", "merged-"))]
