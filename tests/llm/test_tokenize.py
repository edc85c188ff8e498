"""The recursive encoder against the public tokenizer itself."""
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import tokenize as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return T.WordEncoder(T.VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(reference, encoder, texts):
    assert encoder.encode(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["a" * 4001, "ab" * 900, "aaaa aaa", "<|endoftext|>", "\n\n  x\t\ty ", "don't I'LL", "日本語 ünïcode 🙂🙂", "x=-=-=-=", "0" * 1000, " ".join(f"w{i}" for i in range(3000))])
def test_special_texts(reference, encoder, text):
    assert encoder.encode([text, text]) == [reference.encode(text, add_special_tokens=False).ids] * 2


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("size", [T.PIECE - 1, T.PIECE, T.PIECE + 1, 12_000, 100_000, 1_000_000])
def test_long_words_of_random_letters(reference, encoder, size):
    word = "".join(random.Random(size).choices(LETTERS, k=size))
    assert encoder.encode([word]) == [reference.encode(word, add_special_tokens=False).ids]


@pytest.mark.parametrize("word", ["a" * 50_001, "ab" * 20_000, "aab" * 9_000, "-" * 30_001, " " * 40_001 + "x", "internationalization" * 900, "=-" * 7_000 + "=", "日本語テキスト" * 2_000, "0123456789" * 3_000])
def test_long_words_that_repeat(reference, encoder, word):
    assert encoder.encode([word]) == [reference.encode(word, add_special_tokens=False).ids]


def test_words_whose_pieces_share_nothing_go_round_by_round(encoder):
    for word in (b"a" * 50, b"internationalization", b"xqzzy--" * 9):
        assert encoder._round_by_round(word) == encoder.contract([word])[0]


def test_decode_inverts_encode(spark, encoder):
    texts = ["hello  world\n", "", None, "日本語 ünïcode 🙂", "x" * 3000]
    assert encoder.decode([None if t is None else encoder.encode([t])[0] for t in texts]) == texts
    back = T.decode(T.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_operator(spark, reference):
    rows = [(1, "hello world", "clash"), (2, None, "x"), (3, "", None), (1, "hello world", "y"), (None, "z", "z")]
    got = T.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    hello = reference.encode("hello world").ids
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted([(1, hello), (1, hello), (2, []), (3, []), (0, reference.encode("z").ids)])
    assert T.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
