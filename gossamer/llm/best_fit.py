"""Packing pieces of documents into sequences: best fit in partitions, then in a tree over what they leave.

1. Pieces. Documents are encoded where they are read; ids with an end id behind them are cut only where they are longer than a
   sequence. A whole sequence of one piece is done. The rest, a few numbers a piece, is written and dealt evenly.
2. Leaves. Each partition packs its pieces, longest first, each where it leaves the least room. Nearly full bins (less than NEARLY room) are sequences.
3. Tree. FAN partitions at a time send their underfull bins to one node, where bins are the items of another round of best fit; rounds go
   on up to a single node, which emits what is left.

What a node sends up is bounded, and loses no merge. After best fit at most one bin of a node is half full or less, as two of
them would have been put together. So all merges above a node put a bin of another node that is at most half full into one of its own, or its own
such bin elsewhere: at most FAN for each level of the tree. Its FAN * levels emptiest bins (the half full one is among them) can take
all of them that any of its bins could; the others are sequences as they are.

Places follow from sums: a bin put behind another shifts its pieces by what the other holds. Pieces meet their final sequence
by their bin, in a merge join, for they are many and merged bins few.

Defined results: a null text is empty and its one piece is the end id; a null doc_id is kept; rows with one doc_id are packed each for
itself; of equal lengths, smaller doc_ids (nulls first), then pieces come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_blocks

CAPACITY = 2048
#: Room below which a bin is a sequence; nodes that meet in one; pieces of a leaf.
NEARLY, FAN, LEAF = CAPACITY // 64, 8, 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins by their room, so that best fit is the next room that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, 0  # bit r: some open bin has room r
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.room: list[int] = []

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes an item of this length, and the place in it. Of bins with the same room, the first."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = heapq.heappop(self.open[room])
            if not self.open[room]:
                self.rooms ^= 1 << room
        else:
            bin_, room = len(self.room), self.capacity
            self.room.append(room)
        left = room - length
        self.room[bin_] = left
        if left:
            heapq.heappush(self.open[left], bin_)
            self.rooms |= 1 << left
        return bin_, self.capacity - room


def _ids_of(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_blocks.encoder(tokenizer)
        for batch in batches:
            for part in common.slices(batch, limit=token_blocks.SLICE):
                found, n = encode(part.column("text"))
                stop = np.cumsum(n + 1)
                ids = np.full(stop[-1], end_id, "<u4")
                inner = np.ones(len(ids), bool)
                inner[stop - 1] = False
                ids[inner] = found
                count = n // capacity + 1  # n + 1 ids in all
                row = np.repeat(np.arange(len(part)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] + 1 - start)
                at = (stop - n - 1)[row] + start
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids if asked for: of each document, its ids with the end id, cut where they are longer than a sequence."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids_of(tokenizer or token_blocks.default_tokenizer(), end_id, capacity, with_ids), schema)


def _leaf(capacity: int, carried: int):
    """Best fit of a partition's pieces. `up`: whether the piece's bin goes to the tree; `fill`: what the bin holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        table = table.combine_chunks()
        # an order of its own, whatever order the rows came in
        table = table.take(pa.compute.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")], null_placement="at_start"))
        bins, where = Bins(capacity), []
        for n in table["length"].to_pylist():
            where.append(bins.put(n))
        room = np.array(bins.room, np.int64)
        up = np.zeros(len(room), bool)
        emptiest = np.argsort(-room, kind="stable")[:carried]
        up[emptiest[room[emptiest] >= NEARLY]] = True
        bin_, offset = np.array(where, np.int64).reshape(-1, 2).T
        columns = [*(table[c] for c in table.column_names), pa.array((np.int64(leaf) << 33) + bin_), pa.array(offset.copy()), pa.array(up[bin_]), pa.array(capacity - room[bin_])]
        yield from pa.table(columns, names=[*table.column_names, "bin", "place", "up", "fill"]).to_batches(1 << 16)

    return run


def _node(capacity: int, carried: int):
    """Best fit of a node's bins: the bins that were put together, of which the first has the item that goes up."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "item"], ascending=[False, True], kind="stable")
        bins, rows = Bins(capacity), []
        for fill in items["fill"]:
            rows.append(bins.put(int(fill)))
        room = np.array(bins.room, np.int64)
        emptiest = np.argsort(-room, kind="stable")[:carried]
        up = np.zeros(len(room), bool)
        up[emptiest[room[emptiest] >= NEARLY]] = True
        bin_, base = np.array(rows, np.int64).reshape(-1, 2).T
        first = items["item"].to_numpy()[np.unique(bin_, return_index=True)[1]]  # hosts come first
        return pd.DataFrame({"node": items["node"].to_numpy(), "item": items["item"].to_numpy(), "host": first[bin_], "base": base, "fill": capacity - room[bin_], "up": up[bin_]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, leaves: int | None = None, fan: int = FAN) -> DataFrame:
    """pieces (PIECES; lengths 1 to capacity) with sequence_id and offset: as few sequences as the method finds, each filled from 0 without gaps."""
    spark = pieces.sparkSession
    tables = common.Tables(spark)
    given = tables.keep(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    loose = given.where(F.col("length") < capacity)
    leaves = leaves or max(common.partitions(spark), -(-loose.count() // LEAF))
    levels = 1
    while fan**levels < leaves:
        levels += 1
    carried = fan * levels
    # dealt in turn, after a sort of each partition by Spark, so that a task that runs again deals alike
    packed = tables.keep(loose.repartition(leaves).mapInArrow(_leaf(capacity, carried), PIECES + ", bin long, place long, up boolean, fill long"), "leaves")
    open_ = packed.where("up and place = 0").select(F.shiftright("bin", 33).alias("node"), F.col("bin").alias("item"), "fill")
    merged, names = None, []
    for level in range(levels):
        grouped = open_.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInPandas(_node(capacity, carried if level < levels - 1 else 0), "node long, item long, host long, base long, fill long, up boolean")
        names.append(f"nodes-{level}")
        level_ = tables.keep(grouped, names[-1])
        step = level_.select("item", F.col("host"), "base")
        if merged is None:
            merged = step.select(F.col("item").alias("bin"), F.col("host").alias("sequence"), F.col("base").alias("shift"))
        else:
            later = step.select(F.col("item").alias("sequence"), F.col("host"), "base")
            merged = merged.join(later.hint("merge"), "sequence", "left").select("bin", F.coalesce("host", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("base", F.lit(0))).alias("shift"))
        open_ = level_.where("up and item = host").select("node", "item", "fill")
    moved = tables.keep(merged.where("bin <> sequence"), "merged")
    placed = packed.join(moved.hint("merge"), "bin", "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    loose = placed.select(*columns, F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
    # whole sequences: numbers below zero, by their row in the file they are read from
    whole = given.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = common.materialize(loose.unionByName(whole), "sequences")
    tables.drop("pieces", "leaves", "merged", *names)
    return out


def packed_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids) of packed pieces; with_ids: the pieces with their ids. A group is a sequence, so it has `capacity` ids at most."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = placed.alias("a"), with_ids.dropDuplicates(keys).alias("b")  # equal pieces have equal ids
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b.hint("merge"), same).select("a.sequence_id", "a.offset", "b.ids")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return both.groupBy("sequence_id").agg(F.flatten(in_order).alias("ids")).select("sequence_id", F.size("ids").alias("n_ids"), "ids")
