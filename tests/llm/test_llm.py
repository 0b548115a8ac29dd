"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import textwrap
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gossamer.llm import bwt_dedup, chosen_path, common, decontaminate, exact_dedup, html_text, license_scan, piece_viterbi, quality, token_blocks, toxicity

R = random.Random(7)
VOCAB = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(900)]


def prose(n):
    return " ".join(R.choices(VOCAB, k=n))


BASE = [prose(R.randint(20, 120)) for _ in range(60)]
EDITED = [" ".join("zzz" if i == 11 else w for i, w in enumerate(t.split())) for t in BASE[:12]]
TEXTS = [*BASE, *BASE[:5], BASE[0].upper(), *EDITED, None, "", "", "one", "ONE", "Ü ß 日本 😀 ▁ x́ H̱\tq's", prose(30_000), BASE[20] + "\n" + BASE[21]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0), (None, "nobody's text", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))


def test_exact_dedup(docs, empty):
    got = exact_dedup.decide(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            same = [i for i, t in enumerate(TEXTS) if lower(t) == lower(TEXTS[r["doc_id"]])]
            assert r["keep_id"] == max(same) and r["kept"] == (r["doc_id"] == max(same))
            assert r["group_size"] == len(same) + (3 in same)
            assert r["text_sha256"] == hashlib.sha256(lower(TEXTS[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.dedup(docs).columns == docs.columns


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    rows = [(1, "aa bb", "x"), (2, "AA bb", "y"), (1, "unique text here", "z"), (None, "aa BB", "n"), (None, "only one", "m")]
    names = "doc_id long, text string, gone_id string, own_row int, gone_row int, gone_digest int, own_digest int, Gone_ID_ int"
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], names)
    left = exact_dedup.dedup(table)
    assert left.columns == table.columns and {r["gone_id"] for r in left.collect()} == {"y", "z", "m"}
    long = prose(120)
    edited = " ".join("zzz" if i == 11 else w for i, w in enumerate(long.split()))
    near = [(5, long, "a"), (7, edited, "b"), (7, prose(60), "c"), (None, long, "d")]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in near], names)
    left = chosen_path.keep_one(table)
    assert left.columns == table.columns and {r["gone_id"] for r in left.collect()} == {"a", "c", "d"}
    bench = spark.createDataFrame([(0, edited)], "item_id long, text string")
    left = decontaminate.decontaminate(table, bench)
    assert left.columns == table.columns and {r["gone_id"] for r in left.collect()} == {"c"}


def test_index_hands_on_what_it_cannot_hold(docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.decide(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "KEYS", 3)
    assert sorted(map(tuple, exact_dedup.decide(docs).collect()), key=str) == want


def test_cuckoo_index_grows_and_deletes():
    index = exact_dedup.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, [i])
    assert index.resizes and all(index.find(k) == [i] for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(k) and index.find(k) is None
    assert len(index) == 1500 and index.find(keys[1]) == [1] and not index.delete(keys[0])


def shingles(t):
    w = lower(t).split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near(a, b):
    return bool(a & b) and len(a & b) >= 0.8 * len(a | b)


def near_classes(kinds):
    """A function from a set to the first one that links lead to."""
    kinds = list(dict.fromkeys(kinds))
    root = {k: k for k in kinds}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if near(a, b):
                root[top(a)] = top(b)
    return top


def test_near_join(docs, empty):
    sets = [shingles(t) for t in TEXTS]
    kinds, top = list(dict.fromkeys(sets)), near_classes(sets)
    got = {r["doc_id"]: r for r in chosen_path.join(docs).collect() if r["doc_id"] is not None}
    for i, s in enumerate(sets):
        assert got[i]["class_id"] == min(j for j, o in enumerate(sets) if top(o) == top(s))
        assert got[i]["n_links"] == sum(near(s, k) for k in kinds if k != s)
    assert chosen_path.join(empty).count() == 0
    assert chosen_path.runs_for(0.999) > chosen_path.runs_for(0.9)


def test_repeated_bytes(docs, empty, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 3000)
    first = {}
    raw = [(t or "").encode() for t in TEXTS]
    for i, b in enumerate(raw):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    got = {r["doc_id"]: r for r in bwt_dedup.remove_repeats(docs).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    assert got[None]["n_removed"] == 0 and bwt_dedup.remove_repeats(empty).count() == 0


def test_passage_that_all_share(spark):
    """A passage between texts that differ, or that pairs of documents have: its anchors' contexts differ at its edges."""
    passage = prose(40)
    texts = [f"{prose(8)} {passage} {prose(8)}" for _ in range(20)]
    texts += [f"{texts[k][:30]}{passage}{texts[k][-45:]}" for k in range(10)] + [passage * 3, passage[5:-5], prose(30)]
    raw, first, want = [t.encode() for t in texts], {}, {}
    for i, b in enumerate(raw):
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in enumerate(raw):
        gone = {j + k for j in range(len(b) - 49) if first[b[j : j + 50]] < i for k in range(50)}
        want[i] = (len(gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in bwt_dedup.remove_repeats(docs).collect()} == want


def test_merge_gives_order_and_prefixes():
    rng = np.random.RandomState(1)
    strings = [bytes(rng.choice([98, 99], rng.randint(1, 9)).tolist()) for _ in range(40)]
    shards, parts = [], []
    for k in range(0, 40, 10):
        data = np.frombuffer(b"".join(s + b"\0" for s in strings[k : k + 10]), np.uint8)
        owner = np.repeat(np.arange(10), [len(s) + 1 for s in strings[k : k + 10]])
        order = bwt_dedup.suffix_order(data, owner, 16)
        shards.append(bwt_dedup.transform(data, order))
        parts.append([data[p:].tobytes().split(b"\0")[0] for p in order])
    shard, prefix = bwt_dedup.merge(shards, [10] * 4, 16)
    at, merged = [0] * 4, []
    for s in shard:
        merged.append(parts[s][at[s]])
        at[s] += 1
    assert merged == sorted(merged)
    for a, b, n in zip(merged, merged[1:], prefix[1:], strict=False):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table>a<tr>b<td>c</td></tr><tbody>d<tr><td>e</td></tr></tbody><tfoot>f</tfoot></table>", "a\nb\nd\nf\nc\ne"),
        ("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></semantics></math> holds", "so x=1 holds"),
        ("<p>see <svg><title>no</title><defs><text>no</text></defs><text>label</text></svg>", "see label"),
        ("<p>in <select><option>red<option selected>blue</select> now", "in blue now"),
        ("<p>in <select><option>red<option>blue</select> now", "in red now"),
        ("<p><select multiple><optgroup><option>red<option>blue</optgroup></select>", "red blue"),
    ],
)
def test_html_shows_all_that_browsers_show(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
        ("<div style='visibility:hidden'>no <i style='visibility: visible'>yes</i></div>", "yes"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes<tr><td>a<td>b</table>", " | yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>u</details>", "S\nT\nu"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<p>a<table><tr><td>one<tr><td><ul><li>two</ul></table>b", "a\n\none\n\n- two\n\nb"),
        ("<table><tr><td>x<td><table><tr><td>1<td>2<tr><td>3<td>4</table><td>y</table>", "x | 1 | 2 | y\n  | 3 | 4 |"),
        ("<ol start=0><li>a<li value=7>b<li>c</ol>", "0. a\n7. b\n8. c"),
        ("a<b", "a"),
        ("<a =>x</a><i ==y z='>'>y</i><b \"q\">z</b><u a=\"1>w</u>v", "xyzwv"),
        ("<a title='>'>x</a> 1 < 2 <>", "x 1 < 2 <>"),
    ],
)
def test_html_layout(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "deep", "<a '" * 40_000, "<a b=\"<a b='" * 20_000, "<p><button>" + "<div>" * 40_000 + "x", "<ul>" * 20_000 + "x", "<![CDATA[" * 40_000, "<table><tr><td>x" * 5000, "<table>" + "<tr><td colspan=1000>a<td>b" * 4000, "<" * 400_000])
def test_html_time_grows_with_the_page(page):
    began = time.process_time()
    html_text.render(page)
    assert time.process_time() - began < 10


def test_nested_tables_without_end():
    assert html_text.render("<table><tr><td>x<td>" * 600 + "deep").count("x") == 600


def test_html_of_a_table(spark):
    pages = [(1, "<p>a<p>b", "t"), (None, None, "u"), (2, "", "v"), (1, "<p>a<p>b", "t"), (3, "<p>" + "word " * 200_000, "w")]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, html string, text string")).collect()
    assert [(r["page_id"], r["text"]) for r in got[:4]] == [(1, "a\n\nb"), (None, ""), (2, ""), (1, "a\n\nb")] and got[4]["text"] == ("word " * 200_000).strip()
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_near_join_of_pairs_hidden_in_a_template(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    name = lambda *k: [f"w{'-'.join(map(str, k))}-{i}" for i in range(13)]
    template = [w for k in range(8) for w in name("t", k)][:104]
    # all share 0.88 of their shingles with the template; the first 80 are pairs that share one more
    texts = [" ".join(template + name("pair", i // 2)[:1] + name("own", i)[1:]) for i in range(80)]
    texts += [" ".join(template + name("own", i)) for i in range(80, 240)]
    got = chosen_path.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (i - i % 2, 1) if i < 80 else (i, 0) for i in range(240)}


def test_decontaminate(spark, docs, empty):
    item = TEXTS[30].split()[5:25]
    edited = ["yy" if i in (4, 12) else w for i, w in enumerate(item)]
    items = [(0, " ".join(item)), (1, " ".join(edited)), (2, prose(25)), (3, ""), (4, None), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(docs, bench).collect()}
    assert got[(30, 0)] == 1.0 and got[(30, 1)] > 0.6 and {k[1] for k in got} == {0, 1, 5}
    assert {k[0] for k in got if k[1] == 5} == {i for i, t in enumerate(TEXTS) if lower(t) == "one"}
    split = decontaminate.matches(docs, bench, sent=0)  # seeds are joined by shuffling
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} == set(got)
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontaminate_equals_alignment_of_all_pairs(spark):
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdéñóst", k=r.randint(2, 6))) for _ in range(700)] + ["the"] * 250
    items = [r.choices(vocab, k=r.choice([6, 15, 15, 24, 40])) for _ in range(24)]
    change = lambda ws, share: [r.choice(vocab) if r.random() < share else w for w in ws]
    around = lambda ws: " ".join([*r.choices(vocab, k=r.randint(0, 60)), *ws, *r.choices(vocab, k=r.randint(0, 60))])
    texts = [around([])]
    for i, item in enumerate(items):
        texts += [around(change(item, share)) for share in (0.15, 0.2, 0.25, 0.3)]
        texts.append(around(item).upper())
        if i % 3 == 0:  # a verbatim copy
            texts.append(around(item))
        if i % 3 == 1:  # many copies with one edit, and one verbatim
            edited = [w if k % 3 else "zz" for k, w in enumerate(item)]
            texts += [around(edited) for _ in range(30)] + [around(item)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.matches(table, bench).collect()}
    code: dict[str, int] = {}
    coded = [np.array([code.setdefault(w.casefold(), len(code)) for w in t.split()]) for t in texts]
    want = {}
    for i, item in enumerate(items):
        ws = np.array([code.setdefault(w.casefold(), len(code)) for w in item])
        for d, text in enumerate(coded):
            score = decontaminate.align(ws, text)[0] / (2 * len(ws)) if len(text) else 0
            if score >= decontaminate.MIN_SCORE:
                want[d, i] = score
    assert {k: x["score"] for k, x in got.items()} == want and len(want) > 300
    for (d, i), x in got.items():
        ws = np.array([code[w.casefold()] for w in items[i]])
        assert decontaminate.align(ws, coded[d][x["first_word"] : x["last_word"] + 1])[0] == x["score"] * 2 * len(ws)


def test_alignment():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4, 9])
    assert decontaminate.align(a, b) == (7, 6)


def test_pieces(docs, empty):
    assert all(r["round_trip"] for r in piece_viterbi.round_trips(docs).collect())
    assert piece_viterbi.round_trips(empty).count() == 0
    v = piece_viterbi.pieces(piece_viterbi.default_model())
    pieces = {p: (i, s) for p, (i, s, _) in v.automaton.items()}
    for word in ("hello", " hello", "  unbelievable", "xyzzyx"):
        marked, best = word.replace(" ", "▁"), [0.0]
        for e in range(1, len(marked) + 1):
            best.append(max(best[s] + pieces[marked[s:e]][1] for s in range(e) if marked[s:e] in pieces))
        ids = np.frombuffer(v.segment(word), "<u4")
        score = {i: s for i, s in pieces.values()}
        assert sum(score[i] for i in ids) == best[-1] and v.decode(ids.tolist()) == word


def test_token_ids_are_those_of_whole_texts():
    r = random.Random(11)
    parts = [*"aIzK'.,!<>|-", "İ", "ı", "ß", "ſ", "K", "\u0301", "\u0307", "\u093c", "क", "क़", "é", "J\u030c", "ǅ", "日本", "ﬁ", "½", "٣", "😀", "\u200d", "\u00a0", "\u3000", "\x1c", "\x85", "\0", "<|endoftext|>", "<|STARTOFTEXT|>", "don't", "'S", "We'Ve", "x" * 70, "\u3000" * 70]
    texts = ["".join(r.choices([*parts, " ", " ", "\n", "\t", "\x0b"], k=r.randint(0, 14))) for _ in range(6000)] + ["'İ,'", "", " "]
    encode = token_blocks.WordEncoder(token_blocks.default_tokenizer())
    assert encode.by_word
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for whole in (False, True):
        encode.by_word = not whole
        for k in range(0, len(texts), 500):
            ids, n = encode(pa.array([*texts[k : k + 500], None]).slice(1))
            assert ids.tobytes() == b"".join(want[k + 1 : k + 500]) and [4 * x for x in n] == [len(w) for w in want[k + 1 : k + 500]] + [0]


def test_token_blocks(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_blocks.default_tokenizer())
    got = sorted(token_blocks.write_and_read(docs.where("doc_id is not null")).collect(), key=lambda r: r["start"])
    at = 0
    assert [r["doc_id"] for r in got] == sorted([*range(len(TEXTS)), 3])
    for r in got:
        ids = np.array([*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_blocks.write_and_read(empty).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [7] * 700, [1, 2**31, 3] * 400, list(range(2000)), [9] * 511 + [2**32 - 1]])
def test_pages(ids):
    assert token_blocks.unpack(token_blocks.pack(np.array(ids, np.int64))).tolist() == ids


@pytest.mark.parametrize("model", [quality, toxicity])
def test_classifiers(spark, docs, empty, model):
    bad = [(1000 + i, prose(30) + (" trash %%% scum %%%" if i % 3 == 0 else ""), "en", "s", 1, "x") for i in range(600)]
    more = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 1)) for r in bad if r[0] % 2] + [(1001, None)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in model.score(more, labels).collect()}
    held = [(got[r[0]] > 0.5) == (r[0] % 3 == 1) for r in bad if not r[0] % 2]
    assert sum(held) > 0.95 * len(held) and all(0 <= s <= 1 for s in got.values())
    assert model.score(empty, labels).count() == 0
    assert {r["score"] for r in model.score(docs, labels.limit(0)).collect()} == {0.5}


def test_html():
    page = """<title>no</title><p>a <b>b</b>  c<br>d<p hidden>no<ul><li>x<li>y<ol start=4><li>z</ol></ul><table><tr><th>N<th>V<tr><td>apple<td>1</table><pre> k
  l</pre><script>no</script>&lt;<div style="display:none">no</div></td><3"""
    assert html_text.render(page) == "a b c\nd\n\n- x\n- y\n  4. z\n\nN     | V\napple | 1\n\n k\n  l\n\n<<3"
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("<div>" * 5000 + "deep") == "deep"


def text_of(license, k=-1):
    return [b for name, b in license_scan.TEMPLATES if name == license and not b.startswith("SPDX")][k]


def wrapped(text, mark, columns=60):
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, columns))


def test_licences(spark, docs):
    code = "\n".join(prose(8) for _ in range(40))
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/c/x.py", "code"),
        ("a/b/COPYING", text_of("GPL-3.0", 0)),
        ("a/y.py", None),
        ("z.py", ""),
        ("a/b/own.py", "# licensed under the apache license, version 2.0\n" + prose(50)),
        (None, "x"),
        ("a/y.py", None),
        # whole licence files without their titles, and headers wrapped in comments before and within code
        ("m/LICENSE", "Copyright (c) 2020 Ann Example\n\n" + wrapped(text_of("MIT"), "")),
        ("b3/LICENSE.txt", "Copyright 2020, Bo Example.\nAll rights reserved.\n\n" + wrapped(text_of("BSD-3-Clause"), "")),
        ("b2/LICENSE", "Copyright 2020, Bo Example.\n" + wrapped(text_of("BSD-2-Clause"), "")),
        ("ap/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n" + code),
        ("h/apache.c", wrapped(text_of("Apache-2.0", 1), " *") + "\n" + code),
        ("h/gpl.c", "/* Copyright (C) 2020 Cy */\n" + wrapped(text_of("GPL-3.0", 1), "//", 40) + "\n" + code),
        ("h/lgpl.c", code + "\n" + wrapped(text_of("LGPL-3.0", 1), "#", 70)),
        ("h/mpl.js", wrapped(text_of("MPL-2.0", 1), " *", 50) + "\n" + code),
        ("h/isc.py", wrapped(text_of("ISC"), "#") + "\n" + code),
        ("h/spdx.rs", "// SPDX-License-Identifier: Apache-2.0\n" + code),
        ("h/none.rs", code),
        ("h/long.txt", prose(30_000)),
        # of two licence files of a folder the better one speaks
        ("t/LICENSE-1", text_of("ISC")),
        ("t/LICENSE-2", "Released under the MIT License, as some say"),
        ("t/f", "x"),
    ]
    table = spark.createDataFrame(files, "path string, text string").withColumns({"license": F.lit("clash"), "w": F.lit(1)})
    rows = license_scan.scan(table).collect()
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in rows}
    assert got == {
        "a/LICENSE": ("MIT", None), "a/b/c/x.py": ("GPL-3.0", "a/b"), "a/b/COPYING": ("GPL-3.0", None), "a/y.py": ("MIT", "a"), "z.py": (None, None), "a/b/own.py": ("Apache-2.0", None), None: (None, None),
        "m/LICENSE": ("MIT", None), "b3/LICENSE.txt": ("BSD-3-Clause", None), "b2/LICENSE": ("BSD-2-Clause", None), "ap/LICENSE": ("Apache-2.0", None), "h/apache.c": ("Apache-2.0", None), "h/gpl.c": ("GPL-3.0", None),
        "h/lgpl.c": ("LGPL-3.0", None), "h/mpl.js": ("MPL-2.0", None), "h/isc.py": ("ISC", None), "h/spdx.rs": ("Apache-2.0", None), "h/none.rs": (None, None), "h/long.txt": (None, None),
        "t/LICENSE-1": ("ISC", None), "t/LICENSE-2": ("MIT", None), "t/f": ("ISC", "t"),
    }
    assert len(rows) == len(files) and license_scan.scan(table.limit(0)).count() == 0


def test_long_text_hashes_alike():
    data = (prose(40) + " " + "q" * 900 + " " + prose(40)).encode()
    whole = common.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1]
    assert len(whole) == 81 and len(set(whole.tolist())) == len(set(data.split()))


def test_pipeline_matches_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, TEXTS[40])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    exact = {lower(t): i for i, t in enumerate(TEXTS)}.values()  # the last of equal texts
    top = near_classes([shingles(TEXTS[i]) for i in exact])
    first = {}
    for i in sorted(exact):
        first.setdefault(top(shingles(TEXTS[i])), i)
    code: dict[str, int] = {}
    coded = {i: np.array([code.setdefault(w.casefold(), len(code)) for w in (TEXTS[i] or "").split()]) for i in [*first.values(), 40]}
    clean = {i for i in first.values() if not len(coded[i]) or decontaminate.align(coded[40], coded[i])[0] < decontaminate.MIN_SCORE * 2 * len(coded[40])}
    assert set(got) == clean and 40 not in clean and 30 < len(clean) < len(exact) - 5
    library = piece_viterbi.pieces(piece_viterbi.default_model())
    for i, r in got.items():
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) and library.decode(r["piece_ids"]) == (TEXTS[i] or "")


def test_pipeline_of_empty_and_strange_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, None, "x", 1), (1, None, "x", 2), (2, "", "y", 3), (2, "some words", None, 4), (None, "more words here", "z", 5)]
    names = "doc_id long, text string, own_row string, gone_id int"
    for k, table in enumerate((rows, [])):
        at = f"{tmp_path}/{k}"
        full = spark.createDataFrame(table, names).select("doc_id", "text", F.col("own_row").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), "own_row", "gone_id")
        full.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = full
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == full.columns
        got = corpus_pipeline.run(spark, at).collect()
        assert sorted((r["doc_id"] or 0, r["n_pieces"] > 0) for r in got) == ([(0, True), (2, False), (2, True)] if table else [])


def test_word_vectors_equal_plain_sums(spark):
    texts = ["a b c d e f g h", "b c", "", None, "a a a " * 5]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    dim, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    part = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    w, cut = quality._words(part)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - quality.WINDOW), min(b, i + quality.WINDOW + 1)):
                if i != j:
                    for k in range(quality.SPARSE):
                        want[w[i], dim[k][w[j]]] += sign[k][w[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(table), want, atol=1e-6) and np.abs(want).sum() > 0


def test_network_and_machine_equal_plain_sums():
    rng = np.random.RandomState(3)
    x = rng.randn(300, quality.DIM)
    net = quality.Network(x, (x[:, 0] > 0).astype(float))
    w1, b1, w2, b2 = net.w
    for row, p in zip(x[:5], net(x[:5]), strict=True):
        z = (row - net.mean) / net.scale
        hidden = [max(0.0, sum(z[i] * w1[i, j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        assert abs(p - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    lists = [np.array(sorted(rng.choice(40, rng.randint(0, 12), replace=False)), np.int64) + (100 if k % 2 else 0) for k in range(400)]
    machine = toxicity.FactorizationMachine(lists, np.array([k % 2 for k in range(400)], float))
    terms = np.flatnonzero(machine.active)
    assert len(terms) > 10
    for some in (terms[:1], terms[:7], terms[3:12], terms[:0]):
        at = machine.place[some]
        plain = machine.b + machine.w[at].sum() + sum(machine.v[at[i]] @ machine.v[at[j]] for j in range(len(at)) for i in range(j))
        got = machine.logit(np.zeros(len(at), np.int64), at, 1)[0]
        assert abs(got - plain - getattr(machine, "shift", 0.0)) < 1e-9 or abs(got - plain) < 1e-9
