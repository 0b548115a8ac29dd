import random
import re
from collections import Counter

from gossamer.llm import collocations, common, queries


def plain_report(rows, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= 30}
    out = {}
    for (lang, w), a in cand.items():
        inside = [c for (lg, v), c in cand.items() if lg == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * c >= 80 * a for c in inside):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], s))
    return sorted((lang, i + 1, *x) for lang, xs in out.items() for i, x in enumerate(sorted(xs, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]))


def prose(rnd, n):
    words = ["of", "The", "the", "to", "und", "é", "Éa", "a\x01", "a", "b"]
    out = []
    for _ in range(n):
        out += rnd.choice([["New", "York"], ["as", "well", "as"], ["one", "two", "three", "four"], [rnd.choice(words)], [rnd.choice(words)], ["x%d" % rnd.randrange(500)]])
        out.append(rnd.choice(["", "", "", ".", ",", "\n", "\r", "\x0b"]))
    return rnd.choice([" ", "  ", "\t"]).join(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_report_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["en", "de", None, "und", ""]), prose(rnd, rnd.randrange(0, 120))) for _ in range(150)]
    rows += [("en", None), ("xx", ""), ("en", rows[0][1]), ("en", rows[0][1]), ("zz", "one two three four one two three four " * 40)]
    docs = table(spark, rows).repartition(5).selectExpr("lang", "text", "1 as n", "'x' as phrase", "2 as words")
    expected = plain_report(rows)
    assert [tuple(r) for r in collocations.report(docs).orderBy("lang", "rank").collect()] == expected
    assert len({x[0] for x in expected}) > 3 and len(expected) > 25
    assert [tuple(r) for r in collocations.report(docs, top=5).orderBy("lang", "rank").collect()] == plain_report(rows, 5)


def test_a_full_map_of_pairs_changes_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [("en", prose(rnd, 100)) for _ in range(60)]
    monkeypatch.setattr(collocations, "_bitmap", lambda pairs: b"\xff" * (collocations.BITS // 8))
    assert [tuple(r) for r in collocations.report(table(spark, rows)).orderBy("lang", "rank").collect()] == plain_report(rows)


def test_long_texts_are_cut_at_pieces(spark, monkeypatch):
    rnd = random.Random(7)
    text = prose(rnd, 6000)
    monkeypatch.setattr(collocations, "SLICE", 500)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["en", "de"]), pa.array([text, "a b"])], names=["lang", "text"])
    parts = [p for p in collocations._parts(batch)]
    assert len(parts) > 20 and "".join(t for p in parts for t in p.column("text").to_pylist()) == text + "a b"
    got = Counter()
    for b in collocations._short(iter([batch])):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    monkeypatch.setattr(collocations, "SLICE", 1 << 30)
    whole = Counter()
    for b in collocations._short(iter([batch])):
        for r in b.to_pylist():
            whole[r["lang"], r["phrase"]] += r["n"]
    assert got == whole


def test_scores_beyond_64_bits(spark):
    big = 10**15
    stream = spark.createDataFrame([("en", 1, "a", big * 3), ("en", 1, "b", big * 2), ("en", 2, "a b", big)], collocations.COUNTS)
    assert [tuple(r) for r in collocations.score(stream).collect()] == [("en", 2, "a b", big, big * 3, big * 2, 400_000, None)]


def test_empty_table_leaves_nothing(spark):
    import os

    assert collocations.report(table(spark, [])).collect() == []
    assert not [x for x in os.listdir(common.scratch(spark)) if x.startswith(("collocations-short", "collocations-stream"))]
    assert collocations.report(table(spark, [(None, None)])).collect() == []


def test_query_and_sql_have_the_same_columns():
    assert "op11_collocations" in queries.ORACLE
