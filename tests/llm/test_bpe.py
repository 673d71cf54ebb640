import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.bpe import Encoder, encode, merge_long, merge_short
from vellum.llm.tokenize_queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
ENCODER = Encoder(PATH)


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abc 's\n\t12.,<|endoftext|>é"), st.characters(codec="utf-8")), max_size=120))
def test_round_trip(text):
    tokens = {i: t for t, i in ENCODER.words.ranks.items()}
    assert b"".join(tokens[i] for i in ENCODER.encode(text)).decode() == text
    assert ENCODER.count(text) == len(ENCODER.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_scan_equals_heap(word):
    if word:
        assert merge_short(word, ENCODER.words.ranks) == merge_long(word, ENCODER.words.ranks) or word in ENCODER.words.ranks


@pytest.mark.parametrize("text", ["", "Article 12(3): it's\n\n  two  spaces \t", "<|endoftext|>", "x" * 3_000, " " * 3_000, "日本語 العربية 🙂", "a\u0000b\r\n"])
def test_equals_the_public_tokenizer(reference, text):
    assert ENCODER.encode(text) == reference(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "the act", 0), (3, "the act", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    rows = [(r["doc_id"], r["ids"]) for r in encode(df, PATH).collect()]
    assert rows[0] == (1, []) and rows[1] == (2, []) and rows[2] == rows[3] and len(rows) == 5
    assert encode(df.limit(0), PATH).count() == 0
