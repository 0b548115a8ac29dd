"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest
doc_id stays. Each input partition first feeds its rows to an index of its own, so that a text with very many
copies leaves each task as one row; then rows meet by digest, sorted, and an index for each partition decides. An index holds
KEYS digests at most: sorted rows need no more.

Defined results: a null text counts as empty, and empty texts are equal to each other; a null doc_id is
smaller than any id, and stays only in a group that has no id; repeated rows with one id and text are one
document and are all kept or all dropped (group_size counts rows); rows with one id and different texts are judged each; an empty table gives an empty result; other
columns are ignored by `decide` and returned unchanged by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Live digests that an index holds before it hands them on.
KEYS = 100_000


class CuckooIndex:
    """Digests with a value each, in the buckets of a cuckoo filter.

    A key's 16-bit fingerprint may lie in either of two buckets, in a slot with the digest and its value. The filter
    alone may report a key that isn't there, so a hit is verified against the digest in the slot. When an insertion
    finds no room after `max_kicks` moves, the table doubles and is filled anew from the keys in its slots.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 1024, max_kicks: int = 128):
        self.max_kicks, self.live, self.resizes = max_kicks, 0, 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingerprints: list[list[int]] = [[] for _ in range(buckets)]
        self.slots: list[list[tuple[bytes, list]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def _at(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a live digest."""
        fp, *places = self._places(digest)
        for b in places:
            if fp in self.fingerprints[b]:  # filter
                for k, (key, _) in enumerate(self.slots[b]):  # verify
                    if key == digest:
                        return b, k
        return None

    def find(self, digest: bytes) -> list | None:
        at = self._at(digest)
        return self.slots[at[0]][at[1]][1] if at else None

    def _put(self, digest: bytes, value: list) -> tuple[bytes, list] | None:
        """None, or the key and value that found no room."""
        fp, a, b = self._places(digest)
        if len(self.fingerprints[a]) > len(self.fingerprints[b]):
            a = b
        held = (digest, value)
        for kick in range(self.max_kicks):
            if len(self.fingerprints[a]) < self.SLOTS:
                self.fingerprints[a].append(fp)
                self.slots[a].append(held)
                return None
            k = kick % self.SLOTS
            fp, self.fingerprints[a][k] = self.fingerprints[a][k], fp
            held, self.slots[a][k] = self.slots[a][k], held
            a = self._other(a, fp)
        return held

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that isn't live."""
        self.live += 1
        stored, left = None, self._put(digest, value)
        while left:
            if stored is None:
                stored = [*self.items(), left]
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            left = next((x for x in map(self._put, *zip(*stored, strict=True)) if x), None)

    def delete(self, digest: bytes) -> bool:
        at = self._at(digest)
        if at:
            del self.fingerprints[at[0]][at[1]], self.slots[at[0]][at[1]]
            self.live -= 1
        return at is not None

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.slots:
            yield from bucket

    def __len__(self) -> int:
        return self.live


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_sha256, keep_id, group_size) to one row for each digest, as far as KEYS digests at once allow.

    When so many are live and a new one comes, they are handed on: of rows sorted by digest, each digest gives one row.
    """
    index = CuckooIndex()

    def out() -> pa.RecordBatch:
        rows = [(k, *v) for k, v in index.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        types = [pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["text_sha256", "keep_id", "group_size"])

    for batch in batches:
        for digest, doc_id, n in zip(*(batch.column(c).to_pylist() for c in ("text_sha256", "keep_id", "group_size")), strict=True):
            live = index.find(digest)
            if live is None:
                if len(index) >= KEYS:  # a new digest: of sorted rows, none of those before comes again
                    yield out()
                    index = CuckooIndex()
                index.insert(digest, [doc_id, n])
            elif doc_id is not None and (live[0] is None or doc_id > live[0]):
                index.delete(digest)  # its owner is no longer the row that stays
                index.insert(digest, [doc_id, live[1] + n])
            else:
                live[1] += n
    yield out()


def _digest() -> Column:
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def decide(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", _digest().alias("text_sha256"))
    schema = "text_sha256 binary, keep_id long, group_size long"
    partial = rows.select("text_sha256", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_index_rows, schema)
    live = partial.repartition(F.col("text_sha256")).sortWithinPartitions("text_sha256").mapInArrow(_index_rows, schema)
    return rows.join(live.hint("merge"), "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that share an id but not the text are judged each by its own text."""
    own_id, own_digest = common.fresh(docs, "gone_id"), common.fresh(docs, "gone_digest")
    gone = decide(docs).where(~F.col("kept")).select(F.col("doc_id").alias(own_id), F.unhex("text_sha256").alias(own_digest)).distinct()
    mine = docs.withColumn(common.fresh(docs, "own_digest"), _digest())
    same = mine[common.fresh(docs, "own_digest")] == gone[own_digest]
    return mine.join(gone.hint("merge"), same & mine["doc_id"].eqNullSafe(gone[own_id]), "left_anti").select(docs.columns)
