"""Jaccard self-join on word n-grams by chosen paths.

Each set of five-word shingles follows recursive splits: at every node of a path, a hash of node and token
chooses each token with probability 1/(beta*|set|), and every chosen token leads to a child. Two sets that
share much meet in some leaf. A node's choice depends on nothing but the path and the set, so all paths of a
set are computed where the set is, without a shuffle for each level. Leaves with two sets or more are compared
by brute force on exact sets, all pairs of them; a leaf beyond BLOCK sets is compared as pairs of blocks. The number of repeated runs follows from the target recall.

Sets with equal content are one class from the start, so copies are never expanded into pairs. In a pair of
blocks, only links that connect further groups are handed on (at most one less than its sets); these give the
connected classes. Then each connected class counts exact links, in blocks of bounded size.

Defined results: a null text counts as empty; texts without words are equal; a text of fewer than n words has
one shingle, all its words; repeated rows are copies; rows with a null doc_id keep a null class and no links;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N, THRESHOLD = 5, 0.8
DEPTH, BETA, RECALL = 3, 0.7, 0.999
#: Sets, and bytes of sets, that a block of one brute-force comparison holds, give or take.
BLOCK, BLOCK_BYTES = 2000, 8 << 20


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH, beta: float = BETA) -> int:
    """Runs after which two sets just at the threshold have met with this probability.

    Of the larger set a share of at least j is common (just j where it holds the smaller one, the worst case), so a
    node has a Poisson number of common children with that mean over beta; q is the chance that no common path survives.
    """
    mean, q = threshold / beta, 0.0
    for _ in range(depth):
        q = math.exp(-mean * (1 - q))
    return math.ceil(math.log(1 - recall) / math.log(q))


def shingles(hashes: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct 32-bit shingle hashes of one text's word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint32)
    g = common.ngrams(hashes, min(n, len(hashes)))
    return np.unique((g >> np.uint64(32)).astype(np.uint32))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                _, h, _, cut = common.tokens(*common.buffers(part.column("text")))
                sets = [shingles(h[a:b], n).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "row", "set_key", "tokens"])

    return run


def leaves(tokens: np.ndarray, runs: int, depth: int = DEPTH, beta: float = BETA) -> np.ndarray:
    """Hashes of the ends of all chosen paths of a set."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    tok = common.mix(tokens.astype(np.uint64) + np.uint64(1))
    odds = np.uint64(min(2**32, math.ceil(2**32 / (beta * len(tok)))))
    nodes = common.mix(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32))
    step = max(1, 2_000_000 // len(tok))
    for _ in range(depth):
        found = [np.zeros(0, np.uint64)]  # all paths may end
        for k in range(0, len(nodes), step):
            part = nodes[k : k + step]
            r, c = np.nonzero((tok[None, :] * (part | np.uint64(1))[:, None]) >> np.uint64(32) < odds)
            found.append(common.mix(part[r] ^ (tok[c] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))))
        nodes = np.concatenate(found)
    return np.unique(nodes)


def _paths(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, None] = {}
        for batch in batches:
            paths, keys = [], []
            for key, raw in zip(batch.column("set_key").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if key in last:  # a copy seen a moment ago
                    continue
                if len(last) > 50_000:
                    last.clear()
                last[key] = None
                p = leaves(np.frombuffer(raw, np.uint32), runs)
                paths.append(p)
                keys += [key] * len(p)
            flat = np.concatenate(paths) if paths else np.zeros(0, np.uint64)
            for k in range(0, len(flat), 50_000):
                yield pa.record_batch([pa.array(flat[k : k + 50_000].view(np.int64)), pa.array(keys[k : k + 50_000], pa.binary())], names=["path", "set_key"])

    return run


def similar(sets: list[np.ndarray], threshold: float, left: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later ones that are similar. With `left`, only pairs of the first so many with the rest."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common_n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if common_n >= threshold * (sizes.sum() - common_n) and common_n:
            yield 0, np.array([1])
        return
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    by_token = owner[order]
    first = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for x in range(left or len(sets)):
        t = token[bounds[x] : bounds[x + 1]]
        a, n = first[t], first[t + 1] - first[t]
        if n.sum() == len(t):
            continue  # shares no token
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(by_token[at], minlength=len(sets))
        ok = (both > 0) & (both >= threshold * (sizes + sizes[x] - both))
        ok[: max(x + 1, left or 0)] = False
        if ok.any():
            yield x, np.flatnonzero(ok)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each key from batches that are sorted by it."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != at:
                if rows:
                    yield at, rows
                at, rows = key, []
            rows.append(row)
    if rows:
        yield at, rows


def _links(threshold: float):
    """Links of each pair of blocks of a leaf that connect what wasn't connected in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for (_, i, j), rows in _grouped(batches, ["path", "i", "j"]):
            rows.sort(key=lambda r: (r["block"], r["rep"]))
            left = sum(r["block"] == i for r in rows) if i != j else None
            if len(rows) < 2 or left in (0, len(rows)):
                continue
            root = list(range(len(rows)))

            def top(i, root=root):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for x, ys in similar([np.frombuffer(r["tokens"], np.uint32) for r in rows], threshold, left):
                for y in ys:
                    a, b = sorted((top(x), top(int(y))))
                    if a != b:
                        root[b] = a
                        src.append(rows[x]["rep"])
                        dst.append(rows[int(y)]["rep"])
            if len(src) > 20_000:
                yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src, dst = [], []
        yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _degrees(threshold: float):
    """Exact links of each set within a pair of blocks of a connected class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _grouped(batches, ["component", "i", "j"]):
            rows.sort(key=lambda r: r["block"])
            left = sum(r["block"] == i for r in rows) if i != j else None
            degree = np.zeros(len(rows), np.int64)
            if left is None or 0 < left < len(rows):
                for x, ys in similar([np.frombuffer(r["tokens"], np.uint32) for r in rows], threshold, left):
                    degree[x] += len(ys)
                    degree[ys] += 1
            yield pa.record_batch([pa.array([r["rep"] for r in rows], pa.int64()), pa.array(degree)], names=["rep", "n_links"])

    return run


def _pairs(sets: DataFrame, key: str) -> DataFrame:
    """key, block, i, j, rep: each set (rep, bytes) of a group, dealt into k blocks, in all pairs i <= j of blocks that have its own."""
    k = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    sized = sets.join(sets.groupBy(key).agg(k.alias("k")).hint("merge"), key)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return sized.select(key, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, links: bool = True, rows: bool = False) -> DataFrame:
    """doc_id, class_id (smallest doc_id of all texts connected by links), n_links (different sets at the threshold or more); with `rows` also row, a hash of the text."""
    spark = docs.sparkSession
    sets = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").mapInArrow(_sets(n), "doc_id long, row long, set_key binary, tokens binary"), "shingle-sets")
    # a number for each set: one doc_id may have several
    classes = sets.where("doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max(F.octet_length("tokens")).alias("bytes")).withColumn("rep", F.monotonically_increasing_id())
    classes = common.materialize(classes, "set-classes")

    paths = common.materialize(sets.where("doc_id is not null").mapInArrow(_paths(runs_for(recall, threshold)), "path long, set_key binary").distinct(), "paths")
    leaf = paths.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("sig"), F.min("set_key").alias("low")).where("n > 1")
    # leaves of the same sets need one comparison
    once = leaf.groupBy("n", "sig", "low").agg(F.min("path").alias("path")).select("path")
    members = common.materialize(paths.join(once.hint("shuffle_hash"), "path").join(classes.select("set_key", "rep", "bytes").hint("merge"), "set_key").select("path", "rep", "bytes"), "leaf-members")

    needed = members.select("rep").distinct()
    content = sets.withColumnRenamed("doc_id", "first").join(classes.hint("merge"), ["first", "set_key"]).join(needed.hint("merge"), "rep", "left_semi").select("rep", "tokens").dropDuplicates(["rep"])
    content = common.materialize(content, "leaf-sets")

    blocks = _pairs(members, "path")
    dealt = blocks.join(content.hint("merge"), "rep").repartition(F.col("path"), F.col("i"), F.col("j")).sortWithinPartitions("path", "i", "j")
    found = common.components(dealt.mapInArrow(_links(threshold), "src long, dst long"))
    found = common.materialize(found.withColumnRenamed("node", "rep"), "connected")

    if links:
        sized = common.materialize(found.join(classes.select("rep", "bytes").hint("merge"), "rep"), "sized")
        dealt = _pairs(sized, "component").join(content.hint("merge"), "rep")
        dealt = dealt.repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j")
        degree = dealt.mapInArrow(_degrees(threshold), "rep long, n_links long").groupBy("rep").agg(F.sum("n_links").alias("n_links"))
        found = common.materialize(found.join(degree.hint("merge"), "rep"), "linked")
    else:
        found = found.withColumn("n_links", F.lit(None).cast("long"))
    lowest = found.join(classes.select("rep", "first").hint("merge"), "rep").groupBy("component").agg(F.min("first").alias("class_id"))
    linked = found.join(lowest.hint("merge"), "component").select("rep", "class_id", "n_links")
    named = classes.join(linked.hint("merge"), "rep", "left").select("set_key", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    all_rows, keys = sets.select("doc_id", "row", "set_key"), ["doc_id", *(["row"] if rows else [])]
    out = all_rows.where("doc_id is not null").join(named.hint("merge"), "set_key").select(*keys, "class_id", "n_links")
    return out.unionByName(all_rows.where("doc_id is null").select(*keys, F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class of near copies, with all its columns. Rows that share an id are judged each by its own text."""
    gone = join(docs, links=False, rows=True).where("doc_id <> class_id").select("doc_id", "row")
    return common.without(docs, gone)
