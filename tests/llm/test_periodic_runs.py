import hashlib
import random
import re
import zlib

import numpy as np

from gossamer.llm import periodic_runs, queries


def plain_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[i:] < w[j:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length, run = j - i + q, w[i : j + q]
            if length >= max(12, 2 * q) and not any(run[r:] == run[: length - r] for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def loops(rnd, size):
    w = []
    while len(w) < size:
        u = [rnd.randrange(rnd.choice([1, 2, 4, 30])) for _ in range(rnd.randrange(1, 12))]
        w += u * rnd.choice([1, 1, 2, 3, 6]) + u[: rnd.randrange(len(u) + 1)]
    return w


def test_lyndon_arrays():
    rnd = random.Random(1)
    for _ in range(400):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randrange(1, 40))]
        assert periodic_runs.lyndon(w) == plain_lyndon(w)
    # separators are lowest, and words on two sides of one never meet
    assert periodic_runs.lyndon([0, 1, -1, 0, 1, 1, -1])[:2] == [2, 1]


def test_runs_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        texts = [loops(rnd, rnd.randrange(0, 90)) for _ in range(rnd.randrange(1, 6))]
        got = periodic_runs.find(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        base, expected = 0, []
        for t in texts:
            expected += [(s + base, length, q) for s, length, q in plain_runs(t)]
            base += len(t)
        assert [tuple(r) for r in got.tolist()] == expected


def test_long_loops_take_little_time():
    one = periodic_runs.find(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64))
    assert one.tolist() == [[0, 100_000, 1]]
    two = periodic_runs.find(np.tile(np.arange(700), 100), np.zeros(70_000, np.int64))
    assert two.tolist() == [[0, 70_000, 700]]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "\t ".join("wörd%d" % x for x in loops(rnd, rnd.randrange(0, 120))) if i % 7 else rnd.choice([None, "", " \n ", "one"])) for i in range(160)]
    rows += [(3, rows[3][1]), (None, "a " * 30), (5, "x\x0by\x0cz\r" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as runs", "1 as n_words").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    # a null id has no hash, so nothing is planted
    expected = [plain_digest(i, t) if i is not None else (None, *plain_digest(1, t)[1:]) for i, t in rows]
    assert zlib.crc32(b"1") % 10 != 0
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert sum(r.n_runs > 0 for r in got) > 50


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    for i in sorted(docs)[:80]:
        assert got[i] == plain_digest(i, docs[i])


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.detect(empty).count() == 0
    assert periodic_runs.digests(empty).columns[0] == "doc_id"
    other = spark.createDataFrame([("a " * 12, 1, 2)], "text string, RUNS long, n long")
    row = periodic_runs.detect(other).collect()[0]
    assert (row.n, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (2, 12, [(0, 12, 1)], "a")
