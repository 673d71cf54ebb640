"""Token budgets by slice: count-only Viterbi over a double-array trie.

The pieces of a public vocabulary are read as a unigram model: the piece of rank r weighs
-log(r + OFFSET). A text is normalized as the vocabulary's own tokenizer does it: a space before it,
spaces as a mark. Per segment, a space with the word after it, the best path through the trie gives the
number of tokens. The result is an estimate for a vocabulary that was made by pair merges; the
README states the measured difference.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Weight of a byte that no piece covers; it is one token.
BYTE = -40.0
#: Ranks of a pair-merging vocabulary are no probabilities: the offset flattens the first of them. It
#: was chosen from several on a sample of units; the README has the error there and on other rows.
OFFSET = 45
#: Segments whose counts a worker remembers.
REMEMBER = 500_000
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Trie(NamedTuple):
    """base[s] + byte is the next state if check of it is s; value[s] is a piece's weight or nan."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(weights: dict[bytes, float]) -> Trie:
    """A double-array trie over bytes; state 0 is the root. An empty vocabulary gives a bare root."""
    keys = sorted(k for k in weights if k)
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [math.nan] * size
    free = [1, 1]  # where the search begins, for one child and for several
    todo = [(0, 0, len(keys), 0)]
    check[0] = 0
    while todo:
        state, low, high, depth = todo.pop()
        if low < high and len(keys[low]) == depth:
            value[state] = weights[keys[low]]
            low += 1
        if low == high:
            continue
        starts = [low, *(i for i in range(low + 1, high) if keys[i][depth] != keys[i - 1][depth])]
        labels = [keys[i][depth] for i in starts]
        several = len(labels) > 1
        at, tried = max(1, free[several] - labels[0]), 0
        while True:
            if at + 256 >= len(check):
                base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [math.nan] * len(value)
            if all(check[at + x] < 0 for x in labels):
                break
            at += 1
            tried += 1
        if not several or tried > 64:  # dense below: don't look there again
            free[several] = at + labels[0]
        base[state] = at
        for k, i in enumerate(starts):
            check[at + labels[k]] = state
            todo.append((at + labels[k], i, starts[k + 1] if k + 1 < len(starts) else high, depth + 1))
    base, check, value = np.array(base, np.int32), np.array(check, np.int32), np.array(value)
    used = int(np.nonzero(check >= 0)[0][-1]) + 257
    return Trie(base[:used], check[:used], value[:used])


def piece_weights(model_file: str) -> dict[bytes, float]:
    """Weights of the pieces of a vocabulary file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weights = {}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            rank = -model.get_score(i)
            weights[model.id_to_piece(i).encode()] = -math.log(min(rank, model.vocab_size()) + OFFSET)
    return weights


class Counter:
    """Counts tokens of texts; remembers segments."""

    def __init__(self, trie: Trie):
        self.base, self.check, self.value = (a.tolist() for a in trie)
        self.known: dict[str, int] = {}

    def best_path(self, segment: str) -> int:
        """Number of pieces on the best path, without the path."""
        data = segment.encode("utf-8", "surrogatepass")
        n = len(data)
        weight, count = [-math.inf] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        base, check, value = self.base, self.check, self.value
        for i in range(n):
            w, c = weight[i], count[i] + 1
            if w + BYTE > weight[i + 1]:
                weight[i + 1], count[i + 1] = w + BYTE, c
            state = 0
            for j in range(i, n):
                follow = base[state] + data[j]
                if not base[state] or follow >= len(check) or check[follow] != state:
                    break
                state = follow
                v = w + value[state]
                if v > weight[j + 1]:  # never for nan
                    weight[j + 1], count[j + 1] = v, c
        return count[n]

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for segment in _SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(segment)
            if n is None:
                n = self.best_path(segment)
                if len(known) >= REMEMBER:
                    known.clear()
                if len(segment) <= 64:
                    known[segment] = n
            total += n
        return total


def count_tokens(texts: DataFrame, model_file: str, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, n_chars, tokens) of each row; a null or empty text has 0 tokens. Further columns are ignored."""
    trie = texts.sparkSession.sparkContext.broadcast(build_trie(piece_weights(model_file)))  # bounded by the vocabulary
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(trie.value)
        for batch in batches:
            values = batch.column(1).to_pylist()
            tokens = [counter.count(t) if t else 0 for t in values]
            chars = [len(t) if t else 0 for t in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_chars", "tokens"])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, n_chars bigint, tokens bigint")
