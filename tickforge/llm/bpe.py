"""Byte-level BPE over a public vocabulary, merging by a segment tree."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were split into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once, and ids and bytes that a worker remembers of pieces at most.
BLOCK_CHARS, MEMORY_IDS, MEMORY_BYTES = 4_000_000, 4_000_000, 32_000_000

_NONE = 1 << 62


class SegmentTreeBPE:
    """Merges bytes by rank. A leaf of the tree holds the rank of the pair that begins at its position."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece: the leftmost pair of lowest rank is merged until no pair has a rank."""
        n, ranks = len(data), self.ranks
        if n < 2:
            return [ranks[data]] if n else []
        part = [data[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()  # a leaf for each byte
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i  # of equal ranks the leftmost is the smaller
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        def rate(i: int) -> None:
            j = right[i]
            rank = ranks.get(part[i] + part[j]) if j < n else None
            put(i, _NONE if rank is None else rank << 32 | i)

        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = right[i]
            part[i] += part[j]
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            put(j, _NONE)
            rate(i)
            if left[i] >= 0:
                rate(left[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[part[i]])
            i = right[i]
        return ids


class Encoder(dict):
    """Piece -> number of the piece; ids of all pieces met lie in one array. What was met is forgotten when it grows."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.bpe = SegmentTreeBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a})
        self.find = regex.compile(PIECES).findall
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pool, self.starts, self.lengths, self.bytes = array("i"), array("q"), array("i"), 0

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        ids = self.bpe.merge(data)
        number = len(self.starts)
        self.starts.append(len(self.pool))
        self.lengths.append(len(ids))
        self.pool.extend(ids)
        self.bytes += len(data)
        self[piece] = number
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each; null and empty texts have none."""
        if len(self.pool) > MEMORY_IDS or self.bytes > MEMORY_BYTES:
            self.forget()
        numbers, counts, number = array("q"), [], self.__getitem__
        for text in texts:
            before = len(numbers)
            if text:
                numbers.extend(map(number, self.find(text)))
            counts.append(len(numbers) - before)
        piece = np.frombuffer(numbers, np.int64) if len(numbers) else np.zeros(0, np.int64)
        lengths = np.frombuffer(self.lengths, np.int32)[piece].astype(np.int64) if len(piece) else piece
        ends = np.r_[0, np.cumsum(lengths)]
        bounds = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        per_text = np.diff(ends[bounds])
        if not len(piece):
            return np.zeros(0, np.int32), per_text
        at = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.starts, np.int64)[piece] - ends[:-1], lengths)
        return np.frombuffer(self.pool, np.int32)[at], per_text

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        if len(self.pool) > MEMORY_IDS or self.bytes > MEMORY_BYTES:
            self.forget()
        out, number = np.zeros(len(texts), np.int64), self.__getitem__
        for i, text in enumerate(texts):
            if text:
                numbers = array("q", map(number, self.find(text)))
                out[i] = np.frombuffer(self.lengths, np.int32)[np.frombuffer(numbers, np.int64)].sum() if len(numbers) else 0
        return out


_ENCODERS: dict[int, Encoder] = {}


def ship(spark: SparkSession, vocabulary: str = VOCABULARY) -> Broadcast:
    """The vocabulary file for all executors: below 1 MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(vocabulary).read_bytes())


def encoder(shipped: Broadcast) -> Encoder:
    """This worker's encoder; it outlives a task, as do the pieces it has met."""
    data = shipped.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def blocks(batch: pa.RecordBatch, text: str, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch whose texts have about ``chars`` bytes together, but at least one row each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum([0, *(len_ or 0 for len_ in pc.binary_length(column).to_pylist())])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + chars, "right")) - 1)
        part = batch.slice(at, end - at)
        yield part, column.slice(at, end - at).to_pylist()
        at = end


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ids): the token ids of each whole text, without special tokens, whose names in a text are plain text.

    Empty and null texts give an empty list; rows are neither joined nor shuffled, so repeated rows and null keys come
    out as they are, and other columns aren't read. Each distinct piece is merged once per worker by a segment tree
    over the ranks of adjacent pairs (O(n log n), also for pieces of any length); texts are encoded in bounded blocks.
    """
    shipped = ship(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for batch in batches:
            for part, texts in blocks(batch, text):
                ids, counts = enc.encode(texts)
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
