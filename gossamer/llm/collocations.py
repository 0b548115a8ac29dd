"""Phrases whose words belong together: count streams in prefix and in suffix order, merged in lockstep.

Texts are lower-cased (A-Z), cut into pieces and words; phrases are 1 to 4 words in a row within a piece, counted by language.

1. Counting. Each slice of texts gives its distinct words and pairs with their counts, added up by phrase. Phrases of three and
   four words can only be frequent where all their pairs are, so a second pass counts them there alone. It knows
   frequent pairs by a bitmap of BITS bits, a fixed size at any input: a pair that it takes for a frequent one by chance costs time
   and nothing else. What is counted at least MIN_COUNT times is written as the count stream.
2. Left and right counts. Each phrase is cut after each of its words. Cuts sorted by their first part meet the stream in
   prefix order, cuts sorted by the rest meet it in suffix order, each as a sort-merge join: both sides are read once, in step, and no
   hash table is built.
3. Extensions. A phrase of one word more, less its last word, is an extension to the right, less its first word, one to the left;
   the largest count of each phrase's extensions merges with the stream too. Counts don't grow with length, so a
   longer phrase that holds a candidate implies one that is longer by a single word: those are enough.
4. Report. Ranks are taken in SALTS shares of a language first, then over what these left.

Cut scores and comparisons are decimals of 38 digits. No limit is set on phrases but that of the report.

Defined results: a null text is empty, a null language is `und`; every row counts, so repeated rows count as often; ties rank by count, then
by phrase in UTF-8 byte order; a language without candidates isn't in the report; an empty table gives an empty report; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A phrase goes where a longer one that holds it is counted in so many of 100 of its places.
HELD = 80
#: Bits of the map of frequent pairs (4 MB), and shares of a language that are ranked apart first.
BITS, SALTS = 1 << 25, 64
#: Text bytes that are counted at once.
SLICE = 1 << 20
#: Rows of a batch of counts.
ROWS = 1 << 15
COUNTS = "lang string, words int, phrase string, n long"

#: Kinds of a byte: between words, in a word, between pieces.
KINDS = np.ones(256, np.uint8)
KINDS[[9, 32]] = 0
KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = 2


class _Slice:
    """Words and pairs of some texts, as numbers. A word's number is its place in `vocabulary`, a pair's that in `pairs`."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = common.buffers(part.column("text"))
        words, start, self.opens = common.split(common._LOWER[data], offsets, KINDS)
        coded = words.dictionary_encode()
        self.vocabulary, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        langs = part.column("lang").dictionary_encode()
        self.langs, self.size = langs.dictionary, max(len(self.vocabulary), 1)
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(start, offsets)))
        # every word that another one of its piece follows
        self.firsts = np.flatnonzero(~self.opens[1:])
        whole = (self.lang[self.firsts] * self.size + self.ids[self.firsts]) * self.size + self.ids[self.firsts + 1]
        self.pairs, self.pair_of, self.pair_counts = np.unique(whole, return_inverse=True, return_counts=True)

    def rows(self, lang: np.ndarray, parts: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Counts of phrases; parts: the numbers of their first, second ... words."""
        words = [self.vocabulary.take(pa.array(p)) for p in parts]
        phrase = pc.binary_join_element_wise(*words, " ") if words else pa.array([""] * len(n), pa.string())
        return pa.record_batch([self.langs.take(pa.array(lang)), pa.array(np.full(len(n), len(parts), np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])

    def pair_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, second = np.divmod(self.pairs, self.size)
        return (*np.divmod(rest, self.size), second)

    def frequent(self, bits: np.ndarray) -> np.ndarray:
        """Of each pair of words in a row, whether the map has it."""
        lang, first, second = self.pair_words()
        h = _bit(_hashes(self.langs)[lang], *(_hashes(self.vocabulary)[k] for k in (first, second)))
        return ((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool)[self.pair_of]


def _hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    data, offsets = common.buffers(words)
    # a zero byte behind each word, so that an empty name has one too
    ends = np.zeros(len(data) + len(words), np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))
    ends[at] = data
    value = common._BYTE[ends] * common._POWER[(np.arange(len(ends)) - np.repeat(offsets[:-1] + np.arange(len(words)), np.diff(offsets) + 1)) & 255]
    return common.mix(np.add.reduceat(value, offsets[:-1] + np.arange(len(words))))


def _bit(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    k = np.uint64(0x9E3779B97F4A7C15)
    return (common.mix((lang * k + first) * k + second) % np.uint64(BITS)).astype(np.int64)


_END = re.compile(rb"[.,;:!?\n-\r]")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE bytes. A longer text comes in parts of whole pieces."""
    for part in common.slices(batch, limit=SLICE):
        if len(part) > 1 or (part.column("text")[0].as_py() is None) or len(raw := part.column("text")[0].as_buffer()) <= 2 * SLICE:
            yield part
            continue
        at, raw = 0, raw.to_pybytes()
        while at < len(raw):
            end = _END.search(raw, at + SLICE)
            stop = end.end() if end else len(raw)
            yield pa.record_batch([part.column("lang"), pa.array([raw[at:stop].decode()])], names=["lang", "text"])
            at = stop


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words of a language (as the phrase without words), of words and of pairs."""
    for batch in batches:
        for part in _parts(batch):
            s = _Slice(part)
            lang, n = np.unique(s.lang, return_counts=True)
            yield s.rows(lang, [], n)
            single, n = np.unique(s.lang * s.size + s.ids, return_counts=True)
            yield s.rows(single // s.size, [single % s.size], n)
            lang, first, second = s.pair_words()
            for k in range(0, len(s.pairs), ROWS):
                yield s.rows(lang[k : k + ROWS], [first[k : k + ROWS], second[k : k + ROWS]], s.pair_counts[k : k + ROWS])
        pa.default_memory_pool().release_unused()


def _long(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of phrases of three and four words in which all pairs are frequent."""
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in _parts(batch):
                s = _Slice(part)
                lang, first, second = s.pair_words()
                if not len(s.pairs):
                    continue
                pair = np.full(len(s.ids) + LONGEST, -1, np.int64)  # the frequent pair that starts at each word
                fine = s.frequent(known)
                pair[s.firsts[fine]] = s.pair_of[fine]
                at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
                key, n = np.unique(pair[at] * s.size + s.ids[at + 2], return_counts=True)
                p = key // s.size
                yield s.rows(lang[p], [first[p], second[p], key % s.size], n)
                at = at[pair[at + 2] >= 0]
                key, n = np.unique(pair[at] * len(s.pairs) + pair[at + 2], return_counts=True)
                p, q = np.divmod(key, len(s.pairs))
                yield s.rows(lang[p], [first[p], second[p], first[q], second[q]], n)
            pa.default_memory_pool().release_unused()

    return run


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the map of pairs, as the number of a 64-bit part and its bits."""
    for batch in batches:
        if len(batch):
            both = pc.split_pattern(batch.column("phrase"), " ").flatten()
            h = _hashes(both)
            place = _bit(_hashes(batch.column("lang")), h[0::2], h[1::2])
            yield pa.record_batch([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["part", "bits"])


def _bitmap(pairs: DataFrame) -> bytes:
    """The map of frequent pairs. Parts come to the driver: BITS / 64 rows at most, however many pairs there are."""
    parts = pairs.select("lang", "phrase").mapInArrow(_bits_of, "part long, bits long").groupBy("part").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    rows = parts.toArrow()
    out[rows["part"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _total(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def count_stream(docs: DataFrame, tables: common.Tables, least: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, n): all phrases of at most LONGEST words counted at least so often, and the words of each language (words 0)."""
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    short = tables.keep(_total(given.mapInArrow(_short, COUNTS), least), "collocations-short")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(short.where("words = 2")))
    stream = tables.keep(short.unionByName(_total(given.mapInArrow(_long(bits), COUNTS), least)), "collocations-stream")
    tables.drop("collocations-short")
    return stream


def _part(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def score(stream: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score, longer) of every phrase of two words or more of a count stream.

    l, r, score: counts of the parts, and the score, at the cut with the lowest score (ties: the first);
    longer: the largest count of a phrase that holds this one and has one word more.
    """
    counts = stream.where("words > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    phrases = stream.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": _part(words, 1, F.col("k")), "tail": _part(words, F.col("k") + 1, F.col("words") - F.col("k"))})
    by_head = counts.select(F.col("lang"), F.col("phrase").alias("head"), F.col("n").alias("l"))
    by_tail = counts.select(F.col("lang"), F.col("phrase").alias("tail"), F.col("n").alias("r"))
    both = cuts.join(by_head.hint("merge"), ["lang", "head"]).join(by_tail.hint("merge"), ["lang", "tail"])
    points = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min_by(F.struct("l", "r", "points"), F.struct("points", "k")).alias("cut")
    scored = both.withColumn("points", points).groupBy("lang", "phrase", "words", "a").agg(lowest)
    # a phrase is an extension of what is left without its last, or its first, word
    longer = phrases.where("words > 2").select("lang", "a", F.explode(F.array(_part(words, 1, F.col("words") - 1), _part(words, 2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = scored.join(longer.hint("merge"), ["lang", "phrase"], "left")
    return out.select("lang", "words", "phrase", "a", "cut.l", "cut.r", F.col("cut.points").alias("score"), "longer")


def report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer phrase holds in HELD of their places."""
    from pyspark.sql import Window

    tables = common.Tables(docs.sparkSession)
    stream = count_stream(docs, tables)
    held = F.coalesce(F.expr(f"longer * 100BD >= a * {HELD}BD"), F.lit(False))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = score(stream).where(~held).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    totals = stream.where("words = 0").select("lang", F.col("n"))
    # written, as the stream goes
    out = common.materialize(ranked.join(totals.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    tables.drop("collocations-stream")
    return out
