"""Seeds of decontamination: what a copy must hold, and the same result by each way of joining them."""

import random

import numpy as np
import pytest

from gossamer.llm import decontaminate


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(texts)], "doc_id long, text string")


def every_pair(texts, items, min_score):
    """(document, item): score, for every document that aligns with an item."""
    code: dict[str, int] = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()], np.int64)
    out = {}
    for d, text in enumerate(map(coded, texts)):
        for i, item in enumerate(map(coded, items)):
            score = decontaminate.align(item, text)[0] / (2 * len(item)) if len(text) and len(item) else 0
            if score >= min_score:
                out[d, i] = score
    return out


def edit(r, item, vocab):
    """A copy with words replaced, left out, put in or said twice."""
    out = []
    for w in item:
        kind = r.choices(["keep", "other", "out", "in", "twice"], [8, 2, 1, 2, 1])[0]
        out += {"keep": [w], "other": [r.choice(vocab)], "out": [], "in": [w, r.choice(vocab)], "twice": [w, w]}[kind]
    return out


@pytest.mark.parametrize("min_score", [0.34, 0.5, 0.8])
def test_no_alignment_is_lost(spark, monkeypatch, min_score):
    r = random.Random(int(min_score * 100))
    # few words, so that pairs are common, and items of one to thirty words with some that repeat themselves
    vocab = [f"w{k}" for k in range(60)] + ["the"] * 30
    items = [" ".join(r.choices(vocab, k=r.choice([1, 2, 3, 4, 7, 12, 20, 30]))) for _ in range(14)] + ["the the the the the", "a b a b a b a b"]
    texts = []
    for item in items * 3:
        texts.append(" ".join([*r.choices(vocab, k=r.randint(0, 40)), *edit(r, item.split(), vocab), *r.choices(vocab, k=r.randint(0, 40))]))
    want = every_pair(texts, items, min_score)
    # slots are so few that most are shared, and seeds are joined by shuffling
    monkeypatch.setattr(decontaminate, "SLOTS", 1 << 9)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.matches(table(spark, texts), bench, min_score, sent=0).collect()}
    assert got == want and len(want) > 30


def test_every_alignment_holds_so_many_pairs():
    """Of random copies, each aligned one has need - 1 first words of pairs at least that it shares with its item."""
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(500)]
    tried = 0
    for _ in range(400):
        item = r.sample(vocab, r.randint(3, 30))
        copy = edit(r, item, vocab)
        coded = {w: k for k, w in enumerate(dict.fromkeys([*item, *copy]))}
        if not copy or decontaminate.align(np.array([coded[w] for w in item]), np.array([coded[w] for w in copy]))[0] < len(item):
            continue
        pairs = {(copy[k], copy[k + step]) for step in (1, 2) for k in range(len(copy) - step)}
        firsts = [k for k in range(len(item)) if any(k + step < len(item) and (item[k], item[k + step]) in pairs for step in (1, 2))]
        assert len(firsts) >= decontaminate.needed(len(item), 0.5)[0] - 1
        tried += 1
    assert tried > 100


def test_rows_that_share_ids_and_texts(spark):
    item = "one two three four five six seven"
    texts = ["x " + item, "x " + item, item + " y", None, "", item.upper() + " z"]
    docs = table(spark, texts, ids=[1, 1, 1, 2, 2, None])
    bench = spark.createDataFrame([(7, item), (7, item), (7, "none of these"), (None, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted(((x["doc_id"], x["item_id"], x["score"], x["first_word"], x["last_word"]) for x in decontaminate.matches(docs, bench).collect()), key=str)
    # a repeated row counts once, another text of the same id by itself
    assert got == [(1, 7, 1.0, 0, 6), (1, 7, 1.0, 1, 7), (None, 7, 1.0, 0, 6)]
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=str) == [(2, ""), (2, None)]


def test_a_hot_passage_and_a_long_text(spark):
    item = [f"k{i}" for i in range(20)]
    long = " ".join(" ".join(item) + f" f{j} g{j} h{j}" for j in range(5_000))
    texts = [f"a{i} " + " ".join(item) for i in range(3_000)] + [long]
    got = decontaminate.matches(table(spark, texts), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"), sent=0).collect()
    assert len(got) == 3_001 and all(x["score"] == 1.0 for x in got)
    last = next(x for x in got if x["doc_id"] == 3_000)
    assert (last["first_word"], last["last_word"]) == (0, 19)
