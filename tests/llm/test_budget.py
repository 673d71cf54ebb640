import math
import random

import pytest

from vellum.llm.budget import BYTE, Counter, build_trie, count_tokens
from vellum.llm.budget_queries import TOKENIZERS

WEIGHTS = {b"a": -2.0, b"b": -2.5, b"ab": -3.0, b"abc": -9.0, b"c": -1.0, "▁".encode(): -1.0, "▁a".encode(): -1.5, "é".encode(): -2.0}


def brute_force(data):
    best = {0: (0.0, 0)}
    for i in range(len(data)):
        if i not in best:
            continue
        w, c = best[i]
        steps = [(1, BYTE)] + [(len(k), v) for k, v in WEIGHTS.items() if data.startswith(k, i)]
        for n, v in steps:
            if i + n not in best or w + v > best[i + n][0]:
                best[i + n] = (w + v, c + 1)
    return best[len(data)][1]


def test_viterbi_equals_brute_force():
    counter, rng = Counter(build_trie(WEIGHTS)), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcé x▁") for _ in range(rng.randint(0, 12)))
        assert counter.best_path(text) == brute_force(text.encode())


def test_trie_holds_exactly_its_keys():
    rng = random.Random(2)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 4))): float(-i) for i in range(3_000)}
    trie = build_trie(keys)

    def look_up(key):
        state = 0
        for x in key:
            to = int(trie.base[state]) + x
            if not trie.base[state] or trie.check[to] != state:
                return math.nan
            state = to
        return trie.value[state]

    assert all(look_up(k) == v for k, v in keys.items())
    assert all(math.isnan(look_up(k + b"\x00\x01")) or k + b"\x00\x01" in keys for k in keys)
    assert Counter(build_trie({})).best_path("ab") == 2


def test_close_to_the_tokenizer(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "According to Article 12, the importer must keep the technical file.\n\nNach Artikel 12 bewahrt der Importeur die Akte auf. " * 20
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 5_000, "x")], "unit_id long, text string, tokens string")
    got = {r["unit_id"]: (r["n_chars"], r["tokens"]) for r in count_tokens(df, path).collect()}
    assert abs(got[1][1] / len(model.encode(text)) - 1) < 0.05
    assert got[2] == (0, 0) and got[3] == (0, 0) and got[4][1] > 0
    assert count_tokens(df.limit(0), path).count() == 0
