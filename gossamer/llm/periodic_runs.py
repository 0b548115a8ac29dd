"""Runs of repeated words: Lyndon arrays by grouping, roots extended to runs through longest common extensions.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_WORDS, 2 * q) words that no
neighbouring word extends keeping period q. Texts stay where they are read: nothing is shuffled.

1. A run holds no sequence of GRAM words that isn't met twice in it, and those sequences cover it whole. So words that no
   such sequence covers are set aside (repeatedly, within what is left of each text); all the rest goes on.
2. The first phase of a grouping suffix sorter sorts suffixes into groups by their longest Lyndon prefix, from the
   highest group down: members of a group lengthen the prefix of the nearest lower suffix to their left. The lengths
   are the Lyndon array. It runs twice, under the order of the words' numbers and under its reverse, over the stretches of a
   whole slice of texts at once; a separator that is lower than all words keeps them apart.
3. Every run has a Lyndon root under one of the two orders. Each word with its root is extended to both sides, by the longest
   extension that its root and the place one period on have in common. Names of all blocks of 2, 4, 8 ... words
   (equal names: equal blocks) give these extensions exactly, for all words at once.

Time is n log n in the words of what is left, linear in the rest. Memory is some 25 times the longest text, besides 4 log n bytes for each of its words
in stretches that repeat.

Defined results: a null text is empty, and without words there are no runs; rows are judged one by one, so repeated rows, ties and
null ids change nothing; equal runs are given once; an empty table gives an empty result; columns of the input besides the text are kept, but for
those with the name of a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

MIN_WORDS, GRAM = 12, 6
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon(words: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, under the order of the numbers. Negative numbers are separators; no word crosses them."""
    n = len(words)
    members: list[list[int]] = []  # of each group, places in ascending order; some may have left
    lower: list[int] = []  # the next lower group
    first: dict[int, int] = {}
    for w in sorted(set(words)):
        first[w] = len(members)
        lower.append(len(members) - 1)
        members.append([])
    of = [first[w] for w in words]
    for i, g in enumerate(of):
        members[g].append(i)
    size = [1] * n
    left, right = list(range(-1, n)), list(range(1, n + 2))  # places that no group handled so far holds
    higher = list(range(1, len(members) + 1))
    g = len(members) - 1
    while g >= 0:
        here = [i for i in members[g] if of[i] == g]
        if here and words[here[0]] < 0:
            break  # separators are lowest; all words are done
        k, met = 0, []  # nearest lower places, ascending, each with how many of this group follow it
        for i in here:
            p, q = left[i], right[i]
            left[q] = p
            if p >= 0:
                right[p] = q
                if words[p] >= 0:
                    if k and met[-1][1] == p:
                        met[-1][0] += 1
                    else:
                        met.append([1, p])
                        k += 1
        if k:
            step = size[here[0]]
            if k > 1:
                met.sort(key=lambda x: -x[0])  # stable: places stay ascending
            at = 0
            while at < k:  # those with more followers first, so that they end above the others
                times, moved = met[at][0], {}
                while at < k and met[at][0] == times:
                    p = met[at][1]
                    size[p] += times * step
                    moved.setdefault(of[p], []).append(p)
                    at += 1
                for old, places in moved.items():
                    new = len(members)
                    members.append(places)
                    above = higher[old]
                    lower.append(old)
                    higher.append(above)
                    higher[old] = new
                    if above < len(lower):
                        lower[above] = new
                    for p in places:
                        of[p] = new
        g = lower[g]
    return size


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4 ... words; blocks that pass the end have names of their own."""
    kind = np.int32 if len(x) < 2**31 else np.int64
    out = [np.unique(x, return_inverse=True)[1].astype(kind)]
    step = 1
    while 2 * step <= longest:
        last = out[-1]
        pair = last[:-step].astype(np.int64) * (len(x) + 1) + last[step:] if len(x) > step else np.zeros(0, np.int64)
        name = np.unique(pair, return_inverse=True)[1].astype(kind)
        tail = np.arange(len(x) - len(name)) + (int(name.max()) + 1 if len(name) else 0)
        out.append(np.concatenate([name, tail]).astype(kind))
        step *= 2
    return out


def _ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    n, total = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        # a block may fit twice at the highest level only
        for _ in range(2 if k == len(names) - 1 else 1):
            at = j + total + (1 << k) <= n
            a, b = np.where(at, i + total, 0), np.where(at, j + total, 0)
            total += np.where(at & (names[k][a] == names[k][b]), 1 << k, 0)
    return total


def _behind(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            at = i - total >= 1 << k
            a, b = np.where(at, i - total - (1 << k), 0), np.where(at, j - total - (1 << k), 1)
            total += np.where(at & (names[k][a] == names[k][b]), 1 << k, 0)
    return total


def _stretches(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of texts that may hold runs: all their words lie in sequences of GRAM words that the same stretch has twice."""
    n, scope = len(ids), text.astype(np.uint64)
    keep = np.ones(n, bool)
    while True:
        keyed = common.mix(ids.astype(np.uint64) + (scope << np.uint64(32)))
        grams = common.ngrams(keyed, GRAM)
        whole = keep[: len(grams)].copy()
        for k in range(1, GRAM):
            whole &= keep[k : k + len(grams)]
        at = np.flatnonzero(whole)
        order = at[np.argsort(grams[at], kind="stable")]
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, order[twice], 1)
        np.add.at(edge, order[twice] + GRAM, -1)
        now = np.cumsum(edge[:-1]) > 0
        new = now.copy()  # a stretch starts where a text does, or after a word that isn't covered
        new[1:] &= ~now[:-1] | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        ends = np.flatnonzero(now & np.append(~now[1:] | (text[1:] != text[:-1]), True)) + 1
        long = ends - starts >= MIN_WORDS
        starts, ends = starts[long], ends[long]
        edge = np.zeros(n + 1, np.int32)
        edge[starts] += 1
        edge[ends] -= 1
        now = np.cumsum(edge[:-1]) > 0
        if now.sum() == keep.sum() or not len(starts):
            return starts, ends
        keep, scope = now, np.zeros(n, np.uint64)
        scope[starts] = 1
        scope = np.cumsum(scope).astype(np.uint64)


def find(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of some texts put one after the other, ascending. ids: number of each word; text: number of its text."""
    none = np.zeros((0, 3), np.int64)
    if len(ids) < MIN_WORDS:
        return none
    starts, ends = _stretches(ids, text)
    if not len(starts):
        return none
    sizes = ends - starts
    # stretches one after the other, each with a separator behind it; no two separators are equal
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    x, origin = np.zeros(base[-1], np.int64), np.full(base[-1], -1, np.int64)
    inner = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    origin[inner] = np.arange(len(inner)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    x[inner] = np.unique(ids[origin[inner]], return_inverse=True)[1]
    x[base[1:] - 1] = -1 - np.arange(len(sizes))
    names, found, top = _names(x, int(sizes.max())), [], int(x.max())
    for order in (x, np.where(x < 0, x, top - x)):
        period = np.array(lyndon(np.maximum(order, -1).tolist()), np.int64)[inner]
        after, before = _ahead(names, inner, inner + period), _behind(names, inner, inner + period)
        length = before + period + after
        ok = length >= np.maximum(MIN_WORDS, 2 * period)
        found.append(np.stack([origin[inner[ok]] - before[ok], length[ok], period[ok]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(words: pa.Array, cut: np.ndarray, runs: np.ndarray, n: int) -> pa.Array:
    """Texts without the words that a run holds after its first period, joined by one space."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edge[:-1]) == 0
    kept = words.filter(pa.array(stay))
    bounds = np.concatenate([[0], np.cumsum(stay)])[cut]
    size = np.diff(np.frombuffer(kept.buffers()[1], np.int32)[kept.offset : kept.offset + len(kept) + 1]) if len(kept) else np.zeros(0, np.int64)
    # a space before each word but the first of its text
    gap = np.ones(len(kept), np.int64)
    gap[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
    ends = np.cumsum(size + gap)
    out = np.full(int(ends[-1]) if len(kept) else 0, 32, np.uint8)
    data, _ = common.buffers(kept)
    out[np.arange(len(data)) + np.repeat(np.cumsum(gap), size)] = data
    offsets = np.concatenate([[0], ends])[bounds]
    return pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


#: Columns that detect() adds.
NEW = f"n_words long, runs {RUNS}, collapsed string"


def _detect(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text):
                data, offsets = common.buffers(part.column(text))
                words, start, _ = common.split(data, offsets, common.WORDS)
                cut = np.searchsorted(start, offsets)
                ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(part)), np.diff(cut))
                runs = find(ids, owner)
                spread = np.searchsorted(runs[:, 0], cut).astype(np.int32)
                collapsed = _collapsed(words, cut, runs, len(ids))
                local = runs[:, 0] - cut[np.repeat(np.arange(len(part)), np.diff(spread))] if len(runs) else runs[:, 0]
                rows = pa.StructArray.from_arrays([pa.array(local), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(spread), rows)
                n = pa.array(np.diff(cut).astype(np.int64))
                yield pa.record_batch([*(part.column(c) for c in keep), n, lists, collapsed], names=[*keep, "n_words", "runs", "collapsed"])

    return run


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs besides the text, with n_words, runs (start, length and period in words; by start, then period) and collapsed.

    collapsed: the text without the words that some run holds after its first period, joined by one space.
    """
    new = StructType.fromDDL(NEW)
    taken = {f.name for f in new} | {text.lower()}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    names = [f.name for f in kept]
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(text)).mapInArrow(_detect(text, names), StructType([*kept, *new.fields]))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth by a hash of its id goes on in a loop from a place that the hash tells."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("long"))
    # places from 0; only used where there are words
    n = F.when(F.col("n") > 0, F.col("n"))
    planted = planted.withColumn("a", F.col("g") % n).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    looped = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and checksums of all runs and of the collapsed text."""
    found = detect(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
