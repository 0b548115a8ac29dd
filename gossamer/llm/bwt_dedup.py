"""Repeated byte strings, found by merging Burrows-Wheeler transforms of shards.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Texts are dealt into slices of many documents each. In every step a slice sends packed records (hashes and a doc_id) to
buckets of the hashes, a bucket compares the records of all slices, and a short answer to each record goes back. A slice
sends two records of one hash at most, so that no hash is many records, however many documents have it.

1. Every window of LENGTH bytes is owned by its anchor, the k-gram in it with the smallest hash (leftmost on ties).
   Equal windows have equal anchors at equal places, so only anchors that occur in two documents or more matter.
   The windows that one anchor owns in a document are one stretch of bytes, its context. Anchors of one document leave the
   work here, without loss. Where all contexts of an anchor are equal, all but those of the smallest doc_id go.
2. What is left to decide are anchors with several contexts that differ, as at the edges of a passage. Of equal ones,
   those of the smallest doc_id stay in the work and the later ones go.
3. Windows of these that no second document has leave, by hash. The rest forms groups: an anchor and the smallest doc_id with
   a window, with runs of such windows as strings, equal ones being one. All windows of a group
   start in that one document, so its size bounds the group, however many documents share the passage.
4. In each group, strings are cut into shards; each shard gets its own suffix order and
   Burrows-Wheeler transform. The transforms are merged by refining their interleave: in round k, reading the
   transforms in the current order and dealing each suffix's shard to the bucket of its preceding byte gives the
   order by k bytes, and the round in which a boundary first appears is the common prefix length there plus one.
   After LENGTH rounds, slots between boundaries are one repeated interval; no suffix is sorted again.
5. Each interval's smallest doc_id decides for all its windows; spans go back to their documents.

There is one plan for anchors of every size. Contexts are told apart by 128 bits (64 of the anchor, and 64 of the whole context
by other values); hashes of windows only bring together what may be equal, and step 4 compares bytes.

Defined results: a null text counts as empty; documents under LENGTH bytes keep everything; rows with a null doc_id
neither remove nor lose anything; rows with one doc_id never remove from each other; bytes of malformed
sequences count as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 20
#: Text bytes of a slice and of one anchor scan; bytes that one merge and one shard work on; text bytes whose records a bucket holds.
SLICE_BYTES, SCAN_BYTES, MERGE_BYTES, SHARD_BYTES, BUCKET_BYTES = 1 << 19, 1 << 18, 1 << 20, 1 << 17, 1 << 25
#: Spark's settings for what comes to Python at once, in bytes, and from Parquet at once, in rows; a slice and its records are much for a row.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "32"}
#: The answer to a window that one document has.
NONE = np.iinfo(np.int64).min

_random = np.random.RandomState(77)
_VALUE, _OTHER_VALUE = (_random.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2))
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SCAN_BYTES + 4 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 2**64), SCAN_BYTES + 4 * LENGTH)
_OTHER_UP = _powers(_OTHER_BASE, SCAN_BYTES + 4 * LENGTH)
_OTHER_DOWN = _powers(pow(_OTHER_BASE, -1, 2**64), SCAN_BYTES + 4 * LENGTH)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the k-gram at each byte, from prefix sums."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _UP[:n], out=total[1:])
    return common.mix((total[gram:] - total[:-gram]) * _DOWN[: n - gram + 1])


def span_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each span of 4 * LENGTH bytes at most, which come in order of `begin`; other values than those of gram_hashes."""
    out = np.empty(len(begin), np.uint64)
    for lo in range(0, len(data), SCAN_BYTES):
        a, b = np.searchsorted(begin, [lo, lo + SCAN_BYTES])
        if a < b:
            part = data[lo : lo + SCAN_BYTES + 4 * LENGTH]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_OTHER_VALUE[part] * _OTHER_UP[: len(part)], out=total[1:])
            at = begin[a:b] - lo
            out[a:b] = common.mix((total[at + size[a:b]] - total[at]) * _OTHER_DOWN[at])
    return out


def _scan(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of texts that fit into one scan: hash, place, first and last window."""
    span = length - gram + 1  # k-grams in a window
    windows = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return np.zeros(0, np.uint64), none, none, none
    h = gram_hashes(data, gram)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:windows], low[span - size : span - size + windows])
    cuts = offsets[1:-1]
    new = np.empty(windows, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    for edge in (cuts, np.maximum(cuts - length + 1, 0)):  # where a text begins, and where windows begin to reach into it
        new[edge[edge < windows]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], windows) - 1
    within = np.append(cuts, len(data))[np.searchsorted(cuts, first, "right")] - first >= length
    first, last = first[within], last[within]
    place = (low[first] & _PLACE).astype(np.int64)
    return h[place], place, first, last


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of all texts: hash of each anchor, its text, and its context as (start, place in it, windows less one) in the text."""
    found, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SCAN_BYTES, "right")) - 1)
        begin, end = int(offsets[lo]), int(offsets[hi])
        # a longer text is scanned in parts that share what a window needs; a context may then come as two
        for at in range(begin, max(begin + 1, end - length + 1), SCAN_BYTES):
            stop = min(end, at + SCAN_BYTES + length - 1)
            cuts = offsets[lo : hi + 1] - at if hi > lo + 1 else np.array([0, stop - at])
            h, p, a, b = _scan(data[at:stop], cuts, length, gram)
            doc = np.searchsorted(offsets[lo : hi + 1], a + at, "right") - 1 + lo
            found.append((h, doc, a + at - offsets[doc], p - a, b - a))
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---------------------------------------------------------------------------------------------
# Burrows-Wheeler transforms of sets of strings


def suffix_order(data: np.ndarray, string: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their first `depth` bytes; each string ends in a 0, which sorts by string."""
    n = len(data)
    rank = data.astype(np.int64) + int(string[-1]) + 1 if n else np.zeros(0, np.int64)
    ends = data == 0
    rank[ends] = string[ends]
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < depth:
        later = np.zeros(n, np.int64)
        later[:-size] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        s = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def transform(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The byte before each suffix, in suffix order; before a string's first byte stands a 0."""
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[0] = 0
    return before[order]


def merge(transforms: list[np.ndarray], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each suffix in the merged order, and its common prefix with the one before (depth at most).

    strings: how many strings each shard has; their ends sort first, shard by shard.
    """
    sizes = [len(t) for t in transforms]
    n, ends = sum(sizes), sum(strings)
    small = np.uint8 if len(sizes) < 256 else np.uint16
    flat = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(sizes)), sizes).astype(small)
    ends_of = np.repeat(np.arange(len(sizes)), strings).astype(small)
    group = np.zeros(n, np.int32)
    prefix = np.full(n, depth, np.int32)
    prefix[0] = 0
    byte = np.empty(n, np.uint8)
    for k in range(depth):
        byte[np.argsort(shard, kind="stable")] = flat  # the transforms, read in the current order
        deal = np.argsort(byte, kind="stable")
        shard = shard[deal]
        shard[:ends] = ends_of
        dealt, g = byte[deal], group[deal]
        new = np.zeros(n, bool)
        new[1:] = (dealt[1:] != dealt[:-1]) | (g[1:] != g[:-1])
        new[:ends] = True
        if ends < n:
            new[ends] = True
        np.minimum(prefix, np.where(new, k, depth), out=prefix)
        group = np.cumsum(new, dtype=np.int32)
        if new[1:].all():
            break
    return shard, prefix


def smallest_sharers(contexts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each context, the smallest owner of a context that has it."""
    sizes = np.array([len(c) for c in contexts])
    # bytes are shifted by one, and 255 kept apart, so that 0 can end a string: UTF-8 has no byte 255
    shards, at = [], 0
    while at < len(contexts):
        held, end = 0, at
        while end < len(contexts) and (end == at or held + sizes[end] < SHARD_BYTES):
            held += sizes[end] + 1
            end += 1
        data = np.frombuffer(b"".join(contexts[k] + b"\xff" for k in range(at, end)), np.uint8) + np.uint8(1)
        string = np.repeat(np.arange(end - at), sizes[at:end] + 1)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes[at:end] + 1) - sizes[at:end] - 1, sizes[at:end] + 1)
        order = suffix_order(data, string, length)
        shards.append((transform(data, order), end - at, string[order] + at, place[order]))
        at = end
    shard, prefix = merge([s[0] for s in shards], [s[1] for s in shards], length)
    by_shard = np.argsort(shard, kind="stable")
    context, place = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    context[by_shard] = np.concatenate([s[2] for s in shards])
    place[by_shard] = np.concatenate([s[3] for s in shards])
    first = np.flatnonzero(prefix < length)  # intervals that share `length` bytes
    low = np.minimum.reduceat(owner[context], first)
    low = np.repeat(low, np.diff(np.append(first, len(shard))))
    out = [np.full(max(0, s - length + 1), o, np.int64) for s, o in zip(sizes, owner, strict=True)]
    windows = place <= sizes[context] - length
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    flat = np.concatenate(out)
    flat[starts[context[windows]] + place[windows]] = low[windows]
    return [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _windows_of_groups(texts: list[bytes], owner: np.ndarray, group: np.ndarray) -> list[np.ndarray | None]:
    """For each text the smallest owner of each of its windows within its group; None if that is the text's own throughout."""
    _, back, count = np.unique(group, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[back] > 1)  # a group's only text shares its windows with no other
    several = several[np.argsort(back[several], kind="stable")]
    windows: list[np.ndarray | None] = [None] * len(texts)
    at = 0
    while at < len(several):  # groups together, in bounded runs
        held, end = 0, at
        while end < len(several) and (held < MERGE_BYTES or back[several[end]] == back[several[end - 1]]):
            held += len(texts[several[end]]) + 1
            end += 1
        part = several[at:end]
        for k, low in zip(part, smallest_sharers([texts[k] for k in part], owner[part]), strict=True):
            if (low < owner[k]).any():
                windows[k] = low
        at = end
    return windows


def _by_group(work, key: str):
    """Hands `work` rows that are sorted by `key`, gathered up to a bound and on to the end of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            h = batch.column(key).to_numpy()
            if size >= 8 * MERGE_BYTES and held:
                last = held[-1].column(key)[-1].as_py()
                cut = int(np.searchsorted(h, last, "right")) if h[0] == last else 0
                if cut < len(h):
                    held.append(batch.slice(0, cut))
                    yield work(pa.Table.from_batches(held))
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.get_total_buffer_size()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


# ---------------------------------------------------------------------------------------------
# Slices, their records and the answers to them


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice, docs, rows, cuts (where texts begin and end in data), data: many texts in one row."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in common.slices(batch, limit=SLICE_BYTES):
            data, cuts = common.buffers(part.column("text"))
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (part.column("doc_id"), part.column("row"), pa.array(cuts))]
            yield pa.record_batch([pa.array([number]), *lists, pa.array([data.tobytes()], pa.binary())], names=["slice", "docs", "rows", "cuts", "data"])
            number += 1


def _array(batch: pa.RecordBatch, column: str, i: int, kind=np.int64) -> np.ndarray:
    """A binary value as numbers; nothing if it is null."""
    value = batch.column(column)[i]
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid and len(value.as_buffer()) else np.zeros(0, kind)


def _numbers(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy()


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _answer(batch: pa.RecordBatch, i: int, order: np.ndarray, kind) -> np.ndarray:
    """The answers to a slice's records, in the order that these had before `order` dealt them."""
    got = batch.column("answers")[i].as_py() or []
    out = np.empty(len(order), kind)
    out[order] = np.frombuffer(b"".join(x["answer"] for x in sorted(got, key=lambda x: x["bucket"])), kind)
    return out


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket, and their buckets in that order. Hashes of anchors are small ones, so they are mixed again."""
    bucket = (common.mix(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order].astype(np.int32)


def _parcels(number: int, bucket: np.ndarray, records: np.ndarray, texts: list[bytes] | None = None) -> pa.RecordBatch:
    """bucket, slice, body (and text) of a slice's records, which are sorted by bucket."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    bounds = np.append(first, len(bucket))
    body = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * records.shape[1] * 8).astype(np.int32)), pa.py_buffer(records.tobytes())])
    columns = [pa.array(bucket[first]), pa.array(np.full(len(first), number)), body]
    if texts is not None:
        columns.append(pa.array([b"".join(texts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
    return pa.record_batch(columns, names=["bucket", "slice", "body", "text"][: len(columns)])


def _extremes(keys: list[np.ndarray], *values: np.ndarray):
    """Which distinct key each row has (the last of `keys` is the main one), the first row of each in their order, and smallest and largest values of each."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    ends = [(f.reduceat(v[order], first) if len(first) else v[:0]) for v in values for f in (np.minimum, np.maximum)]
    return of, order[first], *ends


class Deal:
    """Deals records of slices by the hash that is first in them, has `work` answer those of a bucket together, and gives each slice its answers."""

    def __init__(self, slices: DataFrame, tables: common.Tables):
        text = slices.count() * SLICE_BYTES  # about; Parquet's footers have the count
        self.tables, self.tasks = tables, max(1, min(common.partitions(slices.sparkSession), text >> 20))
        self.buckets = self.tasks * max(1, -(-text // (self.tasks * BUCKET_BYTES)))

    def answers(self, rows: DataFrame, send, work, name: str, text: bool = False) -> DataFrame:
        parcels = rows.mapInArrow(send(self.buckets), "bucket int, slice long, body binary" + ", text binary" * text)
        dealt = parcels.repartitionById(self.tasks, F.col("bucket") % self.tasks)
        if self.buckets > self.tasks:
            dealt = dealt.sortWithinPartitions("bucket")
        answers = dealt.mapInArrow(_by_group(_answering(work), "bucket"), "bucket int, slice long, answer binary")
        return self.tables.keep(answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers")), name)


def _answering(work):
    def run(table: pa.Table) -> pa.RecordBatch:
        bodies = [c for c in table["body"].chunks if len(c)]
        cuts = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in bodies]
        flat = np.concatenate([np.frombuffer(c.buffers()[2], np.int64)[x[0] // 8 : x[-1] // 8] for c, x in zip(bodies, cuts, strict=True)])
        texts = table["text"].to_pylist() if "text" in table.column_names else None
        answers, words = work(flat, texts) if texts is not None else work(flat)
        counts = np.concatenate([np.diff(x) for x in cuts]) // (8 * words)
        ends = np.concatenate([[0], np.cumsum(counts)]) * answers.dtype.itemsize
        answer = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(answers.tobytes())])
        return pa.record_batch([table["bucket"].combine_chunks(), table["slice"].combine_chunks(), answer], names=["bucket", "slice", "answer"])

    return run


# ---------------------------------------------------------------------------------------------
# Step 1: anchors


class _Anchors:
    """Anchors of a slice, and the records of them: hash, a context's hash, doc_id; one or two of each hash."""

    def __init__(self, batch: pa.RecordBatch, i: int, buckets: int):
        self.data = _array(batch, "data", i, np.uint8)
        docs, cuts = batch.column("docs")[i].values, _numbers(batch, "cuts", i)
        h, text, start, _, more = anchors(self.data, cuts)
        known = docs.is_valid().to_numpy(zero_copy_only=False)[text]
        text = text[known]
        self.h, self.begin, self.size = h[known], cuts[text] + start[known], more[known] + LENGTH
        self.doc = docs.fill_null(0).to_numpy()[text]
        self.c = span_hashes(self.data, self.begin, self.size)
        self.of, at, self.low, high, one, other = _extremes([self.h], self.doc, self.c)
        more = np.flatnonzero((self.low < high) | (one < other))
        keys = np.concatenate([self.h[at], self.h[at][more]])
        self.records = np.stack([keys.view(np.int64), np.concatenate([one, other[more]]).view(np.int64), np.concatenate([self.low, high[more]])], 1)
        self.order, self.bucket = _dealt(keys, buckets)


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a = _Anchors(batch, i, buckets)
                yield _parcels(batch.column("slice")[i].as_py(), a.bucket, a.records[a.order])

    return run


def _judge_anchors(flat: np.ndarray) -> tuple[np.ndarray, int]:
    """1: an earlier document has the anchor; 2: two documents have it, and it has several contexts."""
    h, c, doc = (np.ascontiguousarray(x) for x in flat.reshape(-1, 3).T)
    of, _, low, high, one, other = _extremes([h], doc, c.view(np.uint64))
    return ((low[of] < doc) + 2 * ((low < high) & (one < other))[of]).astype(np.uint8), 3


def _dense(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the spans cover, and where each begins in them."""
    covered = _covered(len(data), begin, size)
    return data[covered], (np.cumsum(covered) - 1)[begin] if len(begin) else begin


def _covered(n: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    edges = np.bincount(begin, minlength=n + 1) - np.bincount(begin + size, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _mixed(buckets: int):
    """slice, gone (spans that go, packed), contexts that differ (hash of the anchor and their own, doc_id, packed span, place in data), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a = _Anchors(batch, i, buckets)
                code = _answer(batch, i, a.order, np.uint8)[: len(a.low)]  # the second record of a hash knows no more
                mixed, span = (code & 2 > 0)[a.of], a.begin * 128 + a.size
                later = ~mixed & ((code & 1 > 0)[a.of] | (a.doc > a.low[a.of]))
                data, at = _dense(a.data, a.begin[mixed], a.size[mixed])
                contexts = np.stack([a.h[mixed].view(np.int64), a.c[mixed].view(np.int64), a.doc[mixed], span[mixed], at], 1)
                yield pa.record_batch([batch.column("slice").slice(i, 1), _binary([span[later]]), _binary([contexts]), _binary([data])], names=["slice", "gone", "contexts", "data"])

    return run


# ---------------------------------------------------------------------------------------------
# Step 2: contexts that differ


class _Contexts:
    """Contexts of a slice as _mixed gives them, and a record of each distinct one: its hash, its anchor's, the smallest doc_id."""

    def __init__(self, batch: pa.RecordBatch, i: int, buckets: int):
        self.rows = _array(batch, "contexts", i).reshape(-1, 5)
        h, c, self.doc = (np.ascontiguousarray(x) for x in self.rows.T[:3])
        self.of, at, self.low, _ = _extremes([h, c], self.doc)
        self.records = np.stack([c[at], h[at], self.low], 1)
        self.order, self.bucket = _dealt(c[at].view(np.uint64), buckets)


def _send_contexts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                c = _Contexts(batch, i, buckets)
                yield _parcels(batch.column("slice")[i].as_py(), c.bucket, c.records[c.order])

    return run


def _judge_contexts(flat: np.ndarray) -> tuple[np.ndarray, int]:
    """1: an earlier document has the context."""
    c, h, doc = (np.ascontiguousarray(x) for x in flat.reshape(-1, 3).T)
    of, _, low, _ = _extremes([h, c], doc)
    return (low[of] < doc).astype(np.uint8), 3


def _firsts(buckets: int):
    """The rows of _mixed without contexts that an earlier document has, which are among `gone` now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                c = _Contexts(batch, i, buckets)
                later = (_answer(batch, i, c.order, np.uint8) > 0)[c.of] | (c.doc > c.low[c.of])
                rows = c.rows[~later]
                data, at = _dense(_array(batch, "data", i, np.uint8), rows[:, 4], rows[:, 3] & 127)
                gone = np.concatenate([_array(batch, "gone", i), c.rows[later, 3]])
                rows = np.column_stack([rows[:, :4], at])
                yield pa.record_batch([batch.column("slice").slice(i, 1), _binary([gone]), _binary([rows]), _binary([data])], names=["slice", "gone", "contexts", "data"])

    return run


# ---------------------------------------------------------------------------------------------
# Step 3: windows of contexts that differ


class _Windows:
    """Windows of a slice's contexts, and the records of them: hash, doc_id; one or two of each hash."""

    def __init__(self, batch: pa.RecordBatch, i: int, buckets: int):
        self.data = _array(batch, "data", i, np.uint8)
        rows = _array(batch, "contexts", i).reshape(-1, 5)
        self.h, doc, span, at = (np.ascontiguousarray(rows[:, k]) for k in (0, 2, 3, 4))
        count = (span & 127) - LENGTH + 1
        self.context = np.repeat(np.arange(len(rows)), count)
        inner = np.arange(len(self.context)) - np.repeat(np.cumsum(count) - count, count)
        self.at, self.begin, self.doc = at[self.context] + inner, (span >> 7)[self.context] + inner, doc[self.context]
        w = span_hashes(self.data, self.at, np.full(len(self.at), LENGTH))
        self.of, one, self.low, high = _extremes([w], self.doc)
        more = np.flatnonzero(self.low < high)
        keys = np.concatenate([w[one], w[one][more]])
        self.records = np.stack([keys.view(np.int64), np.concatenate([self.low, high[more]])], 1)
        self.order, self.bucket = _dealt(keys, buckets)


def _send_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                w = _Windows(batch, i, buckets)
                yield _parcels(batch.column("slice")[i].as_py(), w.bucket, w.records[w.order])

    return run


def _judge_windows(flat: np.ndarray) -> tuple[np.ndarray, int]:
    """The smallest doc_id that has the window, or NONE if no other has it."""
    w, doc = (np.ascontiguousarray(x) for x in flat.reshape(-1, 2).T)
    of, _, low, high = _extremes([w], doc)
    return np.where(low < high, low, NONE)[of], 2


def _strings(buckets: int):
    """slice, gone, runs of windows that have one smallest doc_id (string, doc_id, begin, windows, the string's smallest doc_id
    in the slice), the distinct strings of these (group, that doc_id, length), and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                w = _Windows(batch, i, buckets)
                first = _answer(batch, i, w.order, np.int64)[: len(w.low)][w.of]
                kept = np.flatnonzero(first != NONE)
                new = np.ones(len(kept), bool)
                new[1:] = (np.diff(kept) > 1) | (np.diff(w.context[kept]) != 0) | (first[kept[1:]] != first[kept[:-1]])
                starts = np.flatnonzero(new)
                windows = np.diff(np.append(starts, len(kept)))
                begin = kept[starts]
                group = common.mix(common.mix(first[begin].view(np.uint64)) ^ w.h[w.context[begin]].view(np.uint64)).view(np.int64)
                at, data = w.at[begin], w.data.tobytes()
                known: dict[tuple[int, bytes], int] = {}
                which = [known.setdefault((g, data[x:y]), len(known)) for g, x, y in zip(group.tolist(), at.tolist(), (at + windows + LENGTH - 1).tolist(), strict=True)]
                which, doc = np.array(which, np.int64), w.doc[begin]
                low = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(low, which, doc)
                runs = np.stack([which, doc, w.begin[begin], windows, low[which]], 1)
                strings = np.stack([np.array([g for g, _ in known], np.int64), low, np.array([len(s) for _, s in known], np.int64)], 1)
                text = pa.array([b"".join(s for _, s in known)], pa.binary())
                yield pa.record_batch([batch.column("slice").slice(i, 1), batch.column("gone").slice(i, 1), _binary([runs]), _binary([strings]), text], names=["slice", "gone", "runs", "strings", "text"])

    return run


# ---------------------------------------------------------------------------------------------
# Step 4: groups of strings, whose transforms are merged


def _cut_up(text: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _send_strings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                records = _array(batch, "strings", i).reshape(-1, 3)
                texts = _cut_up(batch.column("text")[i].as_py(), records[:, 2])
                order, bucket = _dealt(np.ascontiguousarray(records[:, 0]).view(np.uint64), buckets)
                yield _parcels(batch.column("slice")[i].as_py(), bucket, records[order], [texts[k] for k in order.tolist()])

    return run


def _judge_strings(flat: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, int]:
    """Of each string a bit for each window that starts in an earlier document."""
    group, doc, size = flat.reshape(-1, 3).T
    known: dict[tuple[int, bytes], int] = {}
    which = np.array([known.setdefault(x, len(known)) for x in zip(group.tolist(), _cut_up(b"".join(bodies), size), strict=True)], np.int64)
    low = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(low, which, doc)
    found = _windows_of_groups([s for _, s in known], low, np.array([g for g, _ in known], np.int64))
    every = (1 << (size - LENGTH + 1)) - 1
    gone = np.where(doc > low[which], every, 0).astype(np.uint32)
    bits = {k: int((1 << np.flatnonzero(w < low[k])).sum()) for k, w in enumerate(found) if w is not None}
    for at in np.flatnonzero((doc == low[which]) & np.isin(which, list(bits))).tolist():
        gone[at] = bits[int(which[at])]
    return gone, 3


# ---------------------------------------------------------------------------------------------
# Step 5: spans


def _gone(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where spans that go begin in a slice, and their sizes."""
    packed, runs, strings = _array(batch, "gone", i), _array(batch, "runs", i).reshape(-1, 5), _array(batch, "strings", i).reshape(-1, 3)
    order, _ = _dealt(np.ascontiguousarray(strings[:, 0]).view(np.uint64), batch.column("buckets")[i].as_py())
    which, doc, begin, windows, low = runs.T
    bits = _answer(batch, i, order, np.uint32)[which] if len(runs) else np.zeros(0, np.uint32)
    bits = np.where(doc > low, (1 << windows) - 1, bits)
    starts = [(begin + k)[bits >> k & 1 > 0] for k in range(LENGTH - GRAM + 1)]
    starts = np.concatenate(starts)
    return np.concatenate([packed >> 7, starts]), np.concatenate([packed & 127, np.full(len(starts), LENGTH)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text of a slice without the spans that go."""
    for batch in batches:
        for i in range(len(batch)):
            data, cuts = _array(batch, "data", i, np.uint8), _numbers(batch, "cuts", i)
            gone = _covered(len(data), *_gone(batch, i))
            kept = data[~gone].tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])[cuts]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = cuts[:-1][np.diff(cuts) > 0]  # a text's first byte begins a span, whatever is before it
            begins[edges] = gone[edges]
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[cuts])
            left = (cuts - removed).tolist()
            digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
            docs = batch.column("docs")[i].values
            yield pa.record_batch([docs, pa.array(np.diff(cuts)), pa.array(np.diff(removed)), pa.array(spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row and spans of the texts of a slice that lose any."""
    for batch in batches:
        for i in range(len(batch)):
            cuts = _numbers(batch, "cuts", i)
            begin, size = _gone(batch, i)
            order = np.argsort(begin, kind="stable")
            begin, size = begin[order], size[order]
            text = np.searchsorted(cuts, begin, "right") - 1
            first = np.flatnonzero(np.diff(text, prepend=-1))
            at = pa.array(text[first])
            spans = pa.ListArray.from_arrays(np.append(first, len(text)).astype(np.int32), pa.array((begin - cuts[text]) * 128 + size))
            yield pa.record_batch([batch.column("docs")[i].values.take(at), batch.column("rows")[i].values.take(at), spans], names=["doc_id", "row", "spans"])


def _judged(docs: DataFrame, tables: common.Tables) -> DataFrame:
    """Slices with what tells which of their spans go."""
    # small row groups: a slice is one row, and tasks shall share a file's
    options = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 8}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    slices = tables.keep(texts.mapInArrow(_slices, "slice long, docs array<long>, rows array<long>, cuts array<long>, data binary"), "slices", **options)
    deal = Deal(slices, tables)
    contexts = "slice long, gone binary, contexts binary, data binary"
    # the answers are few; slices stay as they are
    answered = lambda rows, answers, how="inner": rows.join(answers.hint("shuffle_hash"), "slice", how)
    anchors = deal.answers(slices.select("slice", "docs", "cuts", "data"), _send_anchors, _judge_anchors, "anchors")
    mixed = tables.keep(answered(slices.drop("rows"), anchors).mapInArrow(_mixed(deal.buckets), contexts), "mixed", **options)
    equal = deal.answers(mixed, _send_contexts, _judge_contexts, "contexts")
    firsts = tables.keep(answered(mixed, equal, "left").mapInArrow(_firsts(deal.buckets), contexts), "firsts", **options)
    tables.drop("anchors", "mixed", "contexts")
    shared = deal.answers(firsts, _send_windows, _judge_windows, "windows")
    strings = answered(firsts, shared, "left").mapInArrow(_strings(deal.buckets), "slice long, gone binary, runs binary, strings binary, text binary")
    strings = tables.keep(strings, "strings", **options)
    tables.drop("firsts", "windows")
    merged = deal.answers(strings, _send_strings, _judge_strings, "merged", text=True)
    judged = answered(strings.drop("text"), merged, "left")
    return slices.join(judged.hint("shuffle_hash"), "slice", "left").withColumn("buckets", F.lit(deal.buckets))


@contextmanager
def _small_batches(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(docs: DataFrame, work, schema: str, name: str) -> DataFrame:
    tables = common.Tables(docs.sparkSession)
    with _small_batches(docs.sparkSession):
        out = tables.keep(_judged(docs, tables).mapInArrow(work, schema), name)
    tables.drop("slices", "strings", "merged")
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text) and its spans that go, each packed as 128 * start + length; neighbouring ones may overlap."""
    return _written(docs, _spans, "doc_id long, row long, spans array<long>", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _written(docs, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "kept")
