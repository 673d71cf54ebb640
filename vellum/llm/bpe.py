"""Encoding with a public byte-level vocabulary, by rank arrays.

A text is cut into words by the vocabulary's pattern. A word's bytes are merged pair by pair: an
array holds the part boundaries and the rank of each adjacent pair; the least rank is found by a
scan, its boundary deleted, and the ranks beside it refreshed. Words beyond SHORT bytes use a heap
in place of the scan, with the same result. Words are remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96
#: Words that a worker remembers.
REMEMBER = 400_000
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings to ranks, from a file with one base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word, by repeated scans of the rank array."""
    if word in ranks:
        return (ranks[word],)
    rank = ranks.get
    bounds = list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]  # pairs[i]: rank of parts i and i + 1
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        at = pairs.index(least)
        del bounds[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = rank(word[bounds[at] : bounds[at + 2]], _NONE)
        if at:
            pairs[at - 1] = rank(word[bounds[at - 1] : bounds[at + 1]], _NONE)
    return tuple(ranks[word[a:b]] for a, b in zip(bounds, bounds[1:]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap and linked parts, in n log n for long words."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01" * n)
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = ranks.get(word[i : after[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, after[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = 0
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(ids)


class _Words(dict):
    """Word to ids; unknown words are merged and remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        if len(data) > SHORT:
            return merge_long(data, self.ranks) if data not in self.ranks else (self.ranks[data],)
        ids = merge_short(data, self.ranks)
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts; null and empty texts have none. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.words = _Words(read_ranks(path))
        self.cut = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.cut(text)))) if text else 0


def encode(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row. Null and empty texts get an empty list; further columns are ignored."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        get, cut = encoder.words.__getitem__, encoder.cut
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                arrays, ends = [], [0]
                for t in part.column(1).to_pylist():
                    ids = np.fromiter(chain.from_iterable(map(get, cut(t))), np.int32) if t else np.empty(0, np.int32)
                    arrays.append(ids)
                    ends.append(ends[-1] + len(ids))
                flat = pa.array(np.concatenate(arrays))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, ids array<int>")
