"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

All pieces of a vocabulary are in one automaton. Reading a text once, the automaton reports at each place the
pieces that end there (its own and those along its output links), and each of them relaxes the best score of
that place; so the best segmentation is known when the text ends. A character without a piece of its own is
written as the pieces of its UTF-8 bytes. A space is the mark U+2581; that mark itself, when it stands in a
text, is written as bytes, so decoding gives back every text exactly.

Where no piece goes on after a word into the next space, and none holds a line feed beside other characters, the best
segmentation of a text is that of its words, each with the spaces before it, one after the other. This is checked when
a model is loaded. Then the pass over a text stops at each word, and a worker keeps the results of words it has
seen, up to a bound in bytes; else it goes through the whole text at once.

The pieces' scores are those of the model file. Of a BPE model they are ranks of merges, whose best sum isn't what
applying the merges in order gives, and no space is put before a text: so the ids are those of the best score, not those of the
library. They decode to the text alike.

Defined results: a null text counts as empty and has no pieces; ties prefer the longer last piece; lone
surrogates can't occur in a column of strings; repeated rows encode alike; an empty table gives an empty
result; other columns are kept, but an existing column of the result's name is replaced.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = re.compile(r" *[^ \n]+|\n| +")
MARK = "▁"
#: Bytes of words and their pieces that a worker keeps, and the longest word among them.
CACHE_BYTES, CACHE_WORD = 48 << 20, 64
#: A piece that goes on from a word into what follows it.
CROSSING = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.DOTALL)


class Pieces:
    """Vocabulary of one model file; the automaton and what decodes ids."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.automaton, self.byte_id, self.single = ahocorasick.Automaton(), {}, set()
        self.raw: list[bytes] = []
        self.by_word = True
        low = 0.0
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.automaton.add_word(piece, (i, score, len(piece)))
                low = min(low, score)
                self.by_word = self.by_word and not CROSSING.search(piece)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.byte_score = low - 10.0
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def segment(self, word: str) -> bytes:
        """Ids of a word's best segmentation as little-endian 32-bit integers."""
        # the mark is no character that a piece may match when it stands in the text itself
        marked = word.replace(MARK, "\0").replace(" ", MARK)
        n, least = len(word), float("-inf")
        best, back = [0.0] + [least] * n, [None] * (n + 1)
        unknown = [i for i, c in enumerate(marked) if c not in self.single]

        def as_bytes(i: int) -> None:
            s = best[i] + self.byte_score * len(word[i].encode())
            if s > best[i + 1]:
                best[i + 1], back[i + 1] = s, (i, None)

        pending = iter([*unknown, n])
        nxt = next(pending)
        for end, (piece, score, size) in self.automaton.iter(marked):
            while nxt < end:
                as_bytes(nxt)
                nxt = next(pending)
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (end + 1 - size, piece)
        while nxt < n:
            as_bytes(nxt)
            nxt = next(pending)
        ids, at = [], n
        while at:
            start, piece = back[at]
            ids += [piece] if piece is not None else [self.byte_id[b] for b in reversed(word[start].encode())]
            at = start
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.segment(text)
        words = SEGMENT.findall(text)
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cache, long = self.cache, {}
        for w in set(words):
            if len(w) > CACHE_WORD:
                long[w] = self.segment(w)
            elif w not in cache:
                ids = cache[w] = self.segment(w)
                self.held += 200 + 2 * len(w) + len(ids)
        return b"".join([long[w] if w in long else cache[w] for w in words] if long else [cache[w] for w in words])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def pieces(model: str) -> Pieces:
    return Pieces(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.record_batch([*(batch.column(c) for c in kept), values], names=[*kept, name])


def _lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _columns(df: DataFrame, *added: str) -> str:
    names = {a.split()[0].strip("`") for a in added}
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names), *added])


def encode(docs: DataFrame, model: str | None = None, column: str = "text", output: str = "piece_ids", check: str | None = None) -> DataFrame:
    """docs with a column of piece ids, and if `check` is given one that says whether they decode to the text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model)
        for batch in batches:
            for part in common.slices(batch, column):
                texts = [t or "" for t in part.column(column).to_pylist()]
                found = [vocab.encode(t) for t in texts]
                out = _with(part, output, _lists(found))
                if check:
                    same = [vocab.decode(np.frombuffer(b, "<u4").tolist()) == t for b, t in zip(found, texts, strict=True)]
                    out = _with(out, check, pa.array(same, pa.bool_()))
                yield out

    added = [f"`{output}` array<int>", *([f"`{check}` boolean"] if check else [])]
    return docs.mapInArrow(run, _columns(docs, *added))


def decode(encoded: DataFrame, model: str | None = None, column: str = "piece_ids", output: str = "decoded") -> DataFrame:
    """encoded with the texts of its piece ids; a null or empty list gives an empty text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in batch.column(column).to_pylist()]
            yield _with(batch, output, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _columns(encoded, f"`{output}` string"))


def round_trips(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(model)
        for batch in batches:
            for part in common.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [vocab.encode(t) for t in texts]
                n = [len(b) // 4 for b in found]
                crc = [zlib.crc32(b) for b in found]
                same = [vocab.decode(np.frombuffer(b, "<u4").tolist()) == t for b, t in zip(found, texts, strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
