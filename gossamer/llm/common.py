"""What the operators of this package share: scratch tables, text buffers, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where driver and executors are one process, an own one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's setting to delete a query's shuffle files when the query ends; what is written needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, compression: str = "zstd", **options) -> None:
    """Write df as Parquet, with the writer's own options if need be. Its shuffle files go when it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression=compression, **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in the shared folder that one operator writes, reads again, and drops when what follows is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.paths[name] = f"{scratch(self.spark)}/{name}-{uuid.uuid4().hex}"
        save(df, path, **options)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that aren't among `gone` (doc_id, and row: xxhash64 of the text), with all their columns."""
    a, b, own = fresh(docs, "gone_id"), fresh(docs, "gone_row"), fresh(docs, "own_row")
    gone, mine = gone.select(F.col("doc_id").alias(a), F.col("row").alias(b)).distinct(), docs.withColumn(own, F.xxhash64("text"))
    return mine.join(gone.hint("merge"), mine["doc_id"].eqNullSafe(gone[a]) & (mine[own] == gone[b]), "left_anti").select(docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets into them; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `limit` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


# ---------------------------------------------------------------------------------------------
# Word hashes

_rng = np.random.RandomState(20240501)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(256)], np.uint64)
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Kinds of a byte. WORDS: white space or not. RUNS: white space, letters and digits, or punctuation.
WORDS = (1 - _SPACE).astype(np.uint8)
RUNS = np.where(_SPACE == 1, 0, 2).astype(np.uint8)
RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_span(data: np.ndarray, cuts: np.ndarray, kinds: np.ndarray, lower: bool, prefix: int | None):
    kind = kinds[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[cuts[cuts < len(data)]] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, len(data)))
    at = np.arange(len(data)) - np.repeat(runs, length)
    value = _BYTE[_LOWER[data] if lower else data] * _POWER[at & 255]
    # each 256 bytes of a long word count differently
    if len(length) and length.max() > 256:
        value += (at >> 8).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if prefix is not None:
        value[at >= prefix] = 0
    sums = np.add.reduceat(value, runs)
    keep = kind[runs] != 0
    return runs[keep], mix(sums[keep]), length[keep]


def tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORDS, lower: bool = True, prefix: int | None = None):
    """Words of concatenated texts: start byte, 64-bit hash and length of each, and n+1 bounds that split them by text.

    Upper case counts as lower case (A-Z only) if `lower`; `prefix` hashes only so many first bytes.
    Works through the bytes in spans, so that memory besides the result is bounded even for one huge text.
    """
    starts, hashes, lengths = [], [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n and kinds[data[end]] == kinds[data[end - 1]] and kinds[data[end]] != 0 and end - at < 64 * SLICE_BYTES:
            end += 1  # a word isn't cut
        lo, hi = np.searchsorted(offsets, [at, end])
        s, h, k = _hash_span(data[at:end], offsets[lo:hi] - at, kinds, lower, prefix)
        starts.append(s + at)
        hashes.append(h)
        lengths.append(k)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(hashes), np.concatenate(lengths), np.searchsorted(s, offsets)


def split(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of concatenated texts as strings, the start byte of each, and whether it is the first of its piece.

    Kind 0 of a byte stands between words, 1 in words, 2 between words that are of two pieces; texts are pieces too.
    """
    kind = kinds[data]
    inside = kind == 1
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    ends = offsets[1:-1]
    ends = ends[ends < len(data)]
    new[ends] = inside[ends]
    starts = np.flatnonzero(new)
    held = np.cumsum(inside)
    bounds = np.append(held[starts] - 1, held[-1] if len(held) else 0)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    breaks = (kind == 2).astype(np.int32)
    breaks[ends] += 1
    piece = np.cumsum(breaks)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = piece[1:] != piece[:-1]
    return words, starts, opens


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    return mix(out)


# ---------------------------------------------------------------------------------------------
# Connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (src, dst); the component is its smallest node.

    Large-star and small-star steps in turn; each halves the depth of every tree, and each round is
    written to the shared folder. Edges never come to the driver. A third of all nodes may hang on one
    hub: minima are aggregated before the shuffle, and joins are left to skew splitting.
    """
    both = lambda e: e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while True:  # ends: each round that changes an edge lowers an end of it
        # large star: every neighbour larger than the node goes to the smallest of node and neighbours
        n = both(e)
        low = n.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = n.where("dst > src").join(low.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        new = materialize(small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct(), "edges")
        moved = new.join(e.hint("merge"), ["src", "dst"], "left_anti").limit(1).count() + e.join(new.hint("merge"), ["src", "dst"], "left_anti").limit(1).count()
        e = new
        if not moved:
            break
    roots = e.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
