"""Token ids in a binary format of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, sorted, encoded with a public tokenizer, and written in ascending doc_id
order, with an end id after each. A page of the format holds the ids of some whole documents:

    magic "PFR1", number of ids, number of blocks (uint32 each)
    for each block: minimum (uint32), start of its packed bits in the payload (uint32)
    for each block: width (uint8), number of exceptions (uint16)
    payload: per block BLOCK values minus the minimum, `width` bits each, most significant bit first
    exceptions: places in the block (uint16 each), then the bits above the width (uint32 each)

All numbers are little-endian. The width of a block is the one that PERCENTILE of its values fit in; what doesn't
fit keeps its low bits in the payload and its high bits in the exception list. The index of block starts lets a
reader decode one block alone. Pages are binary rows of Parquet files, with the documents' ids and lengths beside
them, so that they can lie in any store that Spark writes to and survive lost executors.

Defined results: a null text counts as empty and has the end id only; a null doc_id sorts first; rows with one
doc_id are each written (in order of their texts); an empty table gives no pages and an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK, PERCENTILE, MAGIC = 512, 90, b"PFR1"
#: Ids after which a page ends, with its last document.
PAGE_IDS = 1 << 17
#: Bytes of words and their ids that a worker keeps, and the longest word among them.
CACHE_BYTES, CACHE_WORD = 96 << 20, 64
#: Text bytes that are encoded at once, and words that are in one call.
SLICE = 8 << 20
CALL_WORDS = 2000
#: Normal form and splitting of the default tokenizer. They drop white space and join nothing across it.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII punctuation, without the apostrophe, which may belong to a contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))) + 1, 0).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """One page of ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = rows - low[:, None]
    need = np.sort(_bits(rest), axis=1)
    width = need[:, min(BLOCK - 1, BLOCK * PERCENTILE // 100)] if blocks else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(width * BLOCK // 8)])
    payload = np.zeros(start[-1], np.uint8)
    over = rest >> width[:, None]
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        bits = (rest[which][:, :, None] >> np.arange(w - 1, -1, -1)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(which), -1), axis=1)
        payload[(start[which][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    b, at = np.nonzero(over)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    index = np.stack([low, start[:-1]], axis=1).astype("<u4").tobytes()
    shape = width.astype(np.uint8).tobytes() + np.bincount(b, minlength=blocks).astype("<u2").tobytes()
    return head + index + shape + payload.tobytes() + at.astype("<u2").tobytes() + over[b, at].astype("<u4").tobytes()


def unpack(page: bytes) -> np.ndarray:
    """The ids of a page."""
    if page[:4] != MAGIC:
        raise ValueError("not a page of token blocks")
    n, blocks = np.frombuffer(page, "<u4", 2, 4).astype(int)
    at = 12
    index = np.frombuffer(page, "<u4", 2 * blocks, at).reshape(blocks, 2).astype(np.int64)
    at += 8 * blocks
    width = np.frombuffer(page, np.uint8, blocks, at).astype(np.int64)
    count = np.frombuffer(page, "<u2", blocks, at + blocks).astype(np.int64)
    at += 3 * blocks
    out = np.zeros((blocks, BLOCK), np.int64)
    raw = np.frombuffer(page, np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        packed = raw[at + index[which, 1][:, None] + np.arange(w * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1).reshape(len(which), BLOCK, w).astype(np.int64)
        out[which] = bits @ (1 << np.arange(w - 1, -1, -1))
    at += int((width * BLOCK // 8).sum())
    m = int(count.sum())
    place = np.frombuffer(page, "<u2", m, at).astype(np.int64)
    high = np.frombuffer(page, "<u4", m, at + 2 * m).astype(np.int64)
    b = np.repeat(np.arange(blocks), count)
    out[b, place] |= high << width[b]
    return (out + index[:, :1]).reshape(-1)[:n]


class WordEncoder:
    """Encodes texts as the tokenizer does with each whole text, but every distinct word only once.

    A tokenizer with the normal form and the splitting above never joins what stands on two sides of ASCII white space:
    no character composes with a space, lower-casing looks at single characters, and no match of the pattern holds
    white space. Ids of a text are then the ids of its words, one after the other. Of words, those in ASCII alone
    are lower-cased first, unless they may hold a special token. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.held = Tokenizer.from_file(path), {}, 0
        self.model = self.tokenizer.model
        self.several: set[str] = set()  # words of letters that give several pieces of the splitting
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        parts = (shape["normalizer"] or {}).get("normalizers", [])
        split = ((shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        special = all(re.fullmatch("<[|a-z]+>", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in shape["added_tokens"])
        same = [p["type"] for p in parts] == NORMALIZER and parts[1]["pattern"] == {"Regex": r"\s+"} and parts[1]["content"] == " "
        self.by_word = same and split.get("pattern") == {"Regex": PATTERN} and split["behavior"] == "Removed" and special
        suffix = shape["model"].get("end_of_word_suffix")
        #: ids that end a word, so that many words can be encoded as one text
        self.ends = np.zeros(max(shape["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in shape["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, words: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in words]

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded together where each ends in just one id that ends a word."""
        out = []
        for k in range(0, len(words), CALL_WORDS):
            part = words[k : k + CALL_WORDS]
            raw = self._ids([" ".join(part)])[0]
            stop = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            if len(stop) == len(part) and stop[-1] == len(raw):  # each word gives one end at least, so each gave one
                out += [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
            else:
                found = self._ids(part)
                self.several.update(w for w, ids in zip(part, found, strict=True) if self.ends[np.frombuffer(ids, "<u4")].sum() != 1)
                out += found
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each by the shortest way that gives what the tokenizer gives."""
        known = {}
        letters = {w for w in words if w.isalpha()}
        # lower-case ASCII letters are their own normal form and one piece of the splitting: the model alone gives their ids
        simple = {w for w in letters if w.isascii() and w.islower()}
        for group, encode in ((simple, self._by_model), (letters - simple, self._one_by_one), (set(words) - letters, self._ids)):
            part = list(group)
            known.update(zip(part, encode(part), strict=True))
        return [known[w] for w in words]

    def _known(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words, from what is known or learned."""
        keys = words.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, keys))
        new = [k for k, ids in zip(keys, found, strict=True) if ids is None]
        if not new:
            return found
        learned = dict(zip(new, self._encode(new), strict=True))
        short = {w: ids for w, ids in learned.items() if len(w) <= CACHE_WORD}
        self.cache.update(short)
        self.held += 200 * len(short) + sum(map(len, short.values()))
        return [learned[k] if ids is None else ids for k, ids in zip(keys, found, strict=True)]

    def _units(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of units of which words consist, and the one or two units of each word (-1: none).

        A word of letters with ASCII punctuation behind it is two units, unless the letters are several pieces, whose last may join what follows.
        """
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.several.clear()
            self.held = 0
        # lower-casing changes nothing for the tokenizer, but lets fewer words be learned
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
        coded = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        cores = pc.utf8_rtrim(words, TAIL)
        alpha = pc.utf8_is_alpha(cores)
        coded = pc.if_else(alpha, cores, words).dictionary_encode()
        first, core = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids = self._known(core)
        data, offsets = common.buffers(words)
        size = common.buffers(cores)[1]
        behind = np.where(alpha.to_numpy(zero_copy_only=False), np.diff(offsets) - np.diff(size), 0)
        units = np.full((len(words), 2), -1, np.int64)
        units[:, 0] = first
        cut = np.flatnonzero(behind)
        if len(cut) and self.several:
            odd = pc.is_in(core, pa.array(list(self.several), pa.string())).to_numpy(zero_copy_only=False)[first]
            whole = np.flatnonzero(odd & (behind > 0))
            units[whole, 0] = len(ids) + np.arange(len(whole))
            ids += self._known(words.take(pa.array(whole)))
            cut = np.flatnonzero((behind > 0) & ~odd)
        # tails: the last bytes of their words
        stop = np.concatenate([[0], np.cumsum(behind[cut])])
        raw = data[np.arange(stop[-1]) + np.repeat(offsets[1:][cut] - stop[1:], behind[cut])]
        tails = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        units[cut, 1] = len(ids) + tails.indices.to_numpy()
        return ids + self._known(tails.dictionary), units[at]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            parts = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(b) // 4 for b in parts], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known, units = self._units(coded.dictionary)
        flat, size = np.frombuffer(b"".join(known), "<u4"), np.array([len(b) // 4 for b in known] + [0], np.int64)
        each = size[units].sum(axis=1)  # -1 is the last, of no ids
        at = coded.indices.to_numpy()
        stop = np.concatenate([[0], np.cumsum(each[at])])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[:-1])]).astype(np.int32)), pa.array(flat))
        order = units[at].ravel()
        ids = lists.take(pa.array(order[order >= 0])).flatten().to_numpy()
        cut = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        return ids, stop[cut[1:]] - stop[cut[:-1]]


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PAGES = "shard int, page long, first_place long, n_ids long, doc_ids array<long>, lengths array<long>, body binary"


def _pages(path: str, end_id: int):
    names = ["shard", "page", "first_place", "n_ids", "doc_ids", "lengths", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        page = place = held = 0
        parts: list[np.ndarray] = []
        ids: list = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal page, place, held, parts, ids, lengths
            body = pack(np.concatenate(parts).astype(np.int64))
            row = [shard, page, place, held, ids, lengths, body]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            page, place, held, parts, ids, lengths = page + 1, place + held, 0, [], [], []
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for part in common.slices(batch, limit=SLICE):
                found, n = encode(part.column("text"))
                stop = np.cumsum(n + 1)
                whole = np.full(stop[-1], end_id, "<u4")
                ends = np.zeros(len(whole), bool)
                ends[stop - 1] = True
                whole[~ends] = found
                names_of, first = part.column("doc_id").to_pylist(), 0
                while first < len(stop):  # pages end with the document that fills them
                    before = int(stop[first - 1]) if first else 0
                    last = min(int(np.searchsorted(stop, before + PAGE_IDS - held)), len(stop) - 1)
                    parts.append(whole[before : stop[last]])
                    ids += names_of[first : last + 1]
                    lengths += (n[first : last + 1] + 1).tolist()
                    held += int(stop[last]) - before
                    first = last + 1
                    if held >= PAGE_IDS:
                        yield flush()
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the ids of docs, in ascending doc_id order, to pages under path."""
    spark = docs.sparkSession
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    common.save(ranged.mapInArrow(_pages(tokenizer or default_tokenizer(), end_id), PAGES), path, "uncompressed")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = unpack(row["body"]).astype("<u4"), row["lengths"]
            cut = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int64)))
            start = cut[:-1] + row["first_place"] + row["before"]
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths, pa.int64()), lists], names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (or ids_crc32 of them if `digest`)."""
    pages = spark.read.schema(PAGES).parquet(path)
    shards = pages.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # one row for each written partition
    before = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = pages.join(F.broadcast(before), "shard").select("first_place", "before", "doc_ids", "lengths", "body")
    if not digest:
        return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids array<long>")

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(batches):
            cut, ids = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy().astype("<u4")
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of what was written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{common.scratch(spark)}/token-pages-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark, path, digest=True)
