"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: the text is split by the vocabulary's public pattern; within a piece, symbols
form a doubly linked list and a priority queue holds the possible merges by rank. The
best merge is taken, stale entries are skipped, and the neighbours' new merges enter.
Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PIECES = 200_000  # pieces that a task remembers
CACHED_BYTES = 64  # longer pieces are rare and not remembered


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte.

    Printable Latin-1 stands for itself; every other byte, in order, for a character from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[int], dict, list[bytes]]:
    """(id of each byte, (left id, right id) -> (rank, merged id), byte string of each id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbols = byte_symbols()
    back = {c: b for b, c in enumerate(symbols)}
    vocab = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if not isinstance(pair, str) else pair.split(" ")
        merges[vocab[a], vocab[b]] = rank, vocab[a + b]
    strings = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        strings[i] = bytes(back[c] for c in token)
    return [vocab[c] for c in symbols], merges, strings


class Bpe:
    """Encodes and decodes with the tables of ``read_vocabulary``."""

    def __init__(self, tables: tuple[list[int], dict, list[bytes]]):
        self.first, self.merges, self.strings = tables
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PATTERN)

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece of the split text."""
        ids = [self.first[b] for b in text.encode("utf-8")]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            hit = merges.get((ids[i], ids[i + 1]))
            if hit:
                queue.append((hit[0], i, ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two is part of another merge by now
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                hit = merges.get((ids[i], ids[after[i]]))
                if hit:
                    heapq.heappush(queue, (hit[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0:
                hit = merges.get((ids[before[i]], ids[i]))
                if hit:
                    heapq.heappush(queue, (hit[0], before[i], ids[before[i]], ids[i]))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for null and empty text."""
        out, cache = array("i"), self.cache
        for piece in self.pattern.findall(text or ""):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= CACHED_BYTES:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


def load(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary's tables, of a fixed size of about 1.5 MB, as a broadcast variable; executors need no file."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _arrays(batch: pa.RecordBatch, texts: list[array]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in texts] or [np.empty(0, np.int32)])))


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., ids): the token ids of each text, without special tokens.

    Null and empty texts give an empty list; the strings of special tokens in a text are
    ordinary text; very long texts are encoded whole; every row gives one row, repeats and
    null ids too; columns that are not kept may have any name.
    """
    shared = load(documents.sparkSession, path)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(shared.value)
        for b in batches:
            ids = [bpe.encode(x) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), _arrays(b, ids)], names=[*names, "ids"])

    kinds = dict(documents.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "ids array<int>"
    return documents.select(*names, text_col).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): the texts that ids stand for; bytes that form no UTF-8 come out as U+FFFD."""
    shared = load(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")
