"""Benchmark decontamination: rare n-gram seeds join passages with test items, then Smith-Waterman alignment.

An n-gram is a pair of words, in order, with no word or one word between them. From min_score alone follows how many
pairs of an item a copy must hold, so that the result is that of aligning every document with every item: let an item
have n words, and an alignment m matches and the score 2m - cost >= 2 * min_score * n. Between two matches that follow
each other, the words passed over in the item or in the passage, whichever are more, cost 1 each. So at most
(2m - 2 * min_score * n) / 2 of the m - 1 steps from match to match pass over two words or more, and min_score * n - 1 steps
at least are pairs as above, in the item and in the passage alike, each with an own first word in the item. An item's
most common pairs may therefore be left out, first word by first word, so long as one of so many stays; those
that stay are its seeds. (Longer n-grams can't promise that: an edit in every third word leaves no 3-gram.) Items of which
one matched word is enough have single words as seeds.

How many documents have a pair is counted over all documents. A document's passages around its seeds are written, its seeds
meet the items' seeds in a join, and where they meet, the passage is aligned with the item, word by word. Case is folded in all
scripts. The documents are read twice, however large the benchmark is. What is sent to all executors is a table of
SLOTS bytes, which spares the shuffle of what can't be a seed: a slot that two pairs share costs time and changes no
result. Items' seeds are broadcast only if they are counted to be SENT at most, else both sides are shuffled, salted.

Defined results: null and empty documents and items without words match nothing; repeated items with one id are aligned each, and the best
counts; rows that repeat both id and text count as one; a document matches an item once, by its best place (ties: the first); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of the table that tells which hashes may be seeds; a power of two.
SLOTS = 1 << 24
#: Seeds of items that are sent to all executors; more are joined by shuffling.
SENT = 200_000
#: Parts of each seed in that shuffle, so that one that very many documents have isn't one task's.
SALTS = 16
SCHEMA = "doc_id long, row long, item_id long, score double, first_word long, last_word long, seed_hits long"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and the end of it in the passage."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, case folded, and the bounds that split them by text."""
    folded = pa.array([t if t is None or t.isascii() else t.casefold() for t in texts.to_pylist()], pa.large_string())
    _, h, _, cut = common.tokens(*common.buffers(folded))
    return h, cut


def needed(n: int, min_score: float) -> tuple[int, int]:
    """How many words an alignment of that score with an item of n words matches at least, and how many words it covers at most."""
    return max(1, int(np.ceil(min_score * n - 1e-9))), n + int(np.floor(MATCH * (1 - min_score) * n + 1e-9))


def grams(h: np.ndarray, cut: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Key and place of all pairs of words of a text that have at most one word between them; and of single words if asked for."""
    end = np.repeat(cut[1:], np.diff(cut))
    keys, places = [], []
    for step in (1, 2):
        at = np.flatnonzero(np.arange(step, len(h) + step) < end)
        keys.append(common.mix(common.mix(h[at]) + h[at + step]))
        places.append(at)
    if singles:
        keys.append(common.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        places.append(np.arange(len(h)))
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


def _item_grams(min_score: float):
    """Rows of every pair of an item (single words where one is enough): its place, and what an alignment needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                h, cut = words(part.column("text"))
                size = np.diff(cut)
                limits = np.array([needed(int(n), min_score) for n in size], np.int64).reshape(-1, 2)
                single = limits[:, 0] == 1
                key, place = grams(h, cut, bool(single.any()))
                item = np.searchsorted(cut, place, "right") - 1
                kind = np.arange(len(key)) >= len(key) - len(h) if single.any() else np.zeros(len(key), bool)
                kept = kind == single[item]
                key, place, item = key[kept], place[kept], item[kept]
                columns = [part.column("item_id").take(pa.array(item)), part.column("item_row").take(pa.array(item)), pa.array(limits[item, 0]), pa.array(limits[item, 1]), pa.array(place - cut[item]), pa.array(key)]
                yield pa.record_batch(columns, names=["item_id", "item_row", "need", "span", "start", "key"])

    return run


def _table(keys: DataFrame, span: str) -> np.ndarray:
    """For each slot, the least power of two that no span of a key in it exceeds, as its exponent plus one; 0: no key.

    Spans are compared in Spark and put together in runs of slots, so that the driver gets SLOTS bytes at most.
    """
    run = 1 << 16
    slot = F.col("key").bitwiseAND(SLOTS - 1)
    spans = keys.select(slot.alias("slot"), (F.ceil(F.log2(span)) + 1).cast("int").alias("power")).groupBy("slot").agg(F.max("power").alias("power"))

    def fill(part: pa.Table) -> pa.Table:
        out = np.zeros(run, np.uint8)
        at = part.column("slot").to_numpy()
        out[at % run] = part.column("power").to_numpy()
        return pa.table({"run": pa.array(at[:1] // run), "powers": pa.array([out.tobytes()], pa.binary())})

    table = np.zeros(max(SLOTS, run), np.uint8)
    for r in spans.groupBy((F.col("slot") / run).cast("long")).applyInArrow(fill, "run long, powers binary").toLocalIterator():
        table[r["run"] * run : (r["run"] + 1) * run] = np.frombuffer(r["powers"], np.uint8)
    return table[:SLOTS]


def _counts(shared, singles: bool):
    """In how many rows of a partition's slices each key that the table knows occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in common.slices(batch):
                h, cut = words(part.column("text"))
                key, place = grams(h, cut, singles)
                known = np.flatnonzero(table[key & (len(table) - 1)])
                key, doc = key[known], np.searchsorted(cut, place[known], "right") - 1
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, df = np.unique(key[new], return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(df)], names=["key", "df"])

    return run


def _passages(shared, singles: bool):
    """Passages of a document: stretches around its seeds that hold every alignment through them, as word hashes, and the seeds with their places."""
    names = ["doc_id", "row", "first", "words", "seeds"]
    seeds = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in common.slices(batch):
                h, cut = words(part.column("text"))
                key, place = grams(h, cut, singles)
                power = table[key & (len(table) - 1)]
                known = np.flatnonzero(power)
                known = known[np.argsort(place[known], kind="stable")]
                key, place = key[known], place[known]
                doc = np.searchsorted(cut, place, "right") - 1
                span = np.int64(1) << (power[known].astype(np.int64) - 1)
                lo, hi = np.maximum(place - span + 1, cut[doc]), np.minimum(place + span, cut[doc + 1])
                # stretches that overlap are one; a text's end is a bound, as all lie within theirs
                reach = np.maximum.accumulate(hi) if len(hi) else hi
                below = np.minimum.accumulate(lo[::-1])[::-1] if len(lo) else lo
                new = np.ones(len(key), bool)
                new[1:] = below[1:] >= reach[:-1]
                at = np.flatnonzero(new)
                ends = np.append(at[1:], len(key))
                first, stop, of = below[at], (reach[ends - 1] if len(at) else at), doc[at]
                bounds = pa.array(np.append(at, len(key)), pa.int32())
                columns = [
                    part.column("doc_id").take(pa.array(of)),
                    part.column("row").take(pa.array(of)),
                    pa.array(first - cut[of]),
                    pa.array([h[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(key), pa.array(place - cut[doc])], ["key", "place"])).cast(seeds),
                ]
                yield pa.record_batch(columns, names=names)

    return run


def _aligned(min_score: float):
    names = ["doc_id", "row", "item_id", "score", "first_word", "last_word", "seed_hits"]

    def enough(item: np.ndarray, passage: np.ndarray, need: int, span: int) -> bool:
        """Whether some `span` words hold `need` words of the item."""
        total = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
        span = min(span, len(passage))
        return (total[span:] - total[: len(total) - span]).max() >= need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c) for c in ("item_words", "words", "need", "span", "first")]
            for k, (own, text, need, span, first) in enumerate(zip(*columns, strict=True)):
                item, passage = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(text.as_buffer(), np.uint64)
                if not enough(item, passage, need.as_py(), span.as_py()):
                    continue
                got, stop = align(item, passage)
                share = got / (MATCH * len(item))
                if share >= min_score:
                    _, length = align(item[::-1], passage[:stop][::-1])
                    found.append((k, share, first.as_py() + stop - length, first.as_py() + stop - 1))
            at, score, lo, hi = zip(*found, strict=True) if found else ([], [], [], [])
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([own.column("doc_id"), own.column("row"), own.column("item_id"), pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), own.column("seed_hits")], names=names)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, cut = words(batch.column("text"))
        yield pa.record_batch([batch.column("item_id"), batch.column("item_row"), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["item_id", "item_row", "item_words"])


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, sent: int = SENT) -> DataFrame:
    """doc_id, row (a hash of the text), item_id, score (share of the item's best possible score), first_word, last_word, seed_hits (places of seeds)."""
    spark, tables = docs.sparkSession, common.Tables(docs.sparkSession)
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_row"), "text").distinct()
    own = tables.keep(items.mapInArrow(_item_grams(min_score), "item_id long, item_row long, need long, span long, start long, key long"), "item-grams")
    singles = own.where("need = 1").limit(1).count() > 0

    # of each item's first words of pairs, the need - 2 whose pairs are the most common are left out
    df = texts.select("text").mapInArrow(_counts(share(_table(own, "span")), singles), "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))
    item = ["item_id", "item_row"]
    common_first = Window.partitionBy(*item).orderBy(F.desc("in_all"), "start")
    ranked = own.join(df.hint("merge"), "key", "left").withColumn("in_all", F.coalesce(F.sum("df").over(Window.partitionBy(*item, "start")), F.lit(0))).withColumn("rank", F.dense_rank().over(common_first))
    seeds = tables.keep(ranked.where("rank > need - 2").select(*item, "need", "span", "key").distinct(), "item-seeds")

    passages = tables.keep(texts.mapInArrow(_passages(share(_table(seeds, "span")), singles), "doc_id long, row long, first long, words binary, seeds array<struct<key: long, place: long>>"), "passages")
    hits = passages.select("doc_id", "row", "first", F.explode("seeds").alias("s")).select("doc_id", "row", "first", "s.key", "s.place")
    if seeds.count() <= sent:
        met = hits.join(F.broadcast(seeds), "key")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "first"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["key", "salt"])

    # stretches of a document where an item's seeds are so near each other that their alignments may overlap
    passage = ["doc_id", "row", "first"]
    along = Window.partitionBy(*passage, *item).orderBy("place")
    met = met.select(*passage, *item, "need", "span", "place").distinct()
    met = met.withColumn("new", F.coalesce(F.col("place") - F.lag("place").over(along) >= 2 * F.col("span") - 1, F.lit(True)).cast("int"))
    met = met.withColumn("stretch", F.sum("new").over(along)).groupBy(*passage, *item, "need", "span", "stretch").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("seed_hits"))
    start = F.greatest(F.col("lo") - F.col("span") + 1, F.col("first"))
    met = met.withColumn("start", start).withColumn("size", F.col("hi") + F.col("span") - F.col("start"))

    held = passages.select(*[F.col(c).alias("p_" + c) for c in passage], F.col("words").alias("p_words")).distinct()
    same = [F.col(c).eqNullSafe(F.col("p_" + c)) for c in passage]
    part = F.expr("substring(p_words, cast(8 * (start - first) + 1 as int), cast(8 * size as int))")
    placed = met.join(held.hint("merge"), same).select("doc_id", "row", *item, "need", "span", "seed_hits", F.col("start").alias("first"), part.alias("words"))
    whole = items.mapInArrow(_item_words, "item_id long, item_row long, item_words binary")
    pairs = placed.join(whole.hint("merge"), item).select("doc_id", "row", "item_id", "need", "span", "seed_hits", "first", "words", "item_words")
    scored = pairs.mapInArrow(_aligned(min_score), SCHEMA)
    best = F.min(F.struct((-F.col("score")).alias("s"), "first_word", "last_word", "seed_hits")).alias("b")
    out = scored.groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", (-F.col("b.s")).alias("score"), "b.first_word", "b.last_word", "b.seed_hits")
    kept = common.materialize(out, "matches")
    tables.drop(*list(tables.paths))
    return kept


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no copy of any item, with all their columns. Each row is judged by its own text."""
    return common.without(docs, matches(docs, benchmark, **options))
