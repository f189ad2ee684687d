"""The token store's words as arrays: exact on any text, and no text is encoded whole for its white space."""

import random

import numpy as np

from loomery.llm import token_store
from loomery.llm.queries import tokenizer_path


def test_newer_characters_are_exact():
    """Letters that Unicode got after Python's tables, or after the tokenizer's, are what the tokenizer takes them for."""
    enc = token_store.Encoder(tokenizer_path(), 2)
    points = [0x558, 0x58C, 0x88F, 0x1C89, 0xA7CB, 0xA7D2, 0x105C0, 0x10D4F, 0x1FAE9, *range(0x33470, 0x33480), *range(0x2FFF0, 0x30010)]
    texts = [f"a{c}a {c}1{c}1!{c}! {c}'s" for c in map(chr, points)] + ["plain text", "", "x<|endoftext|>y"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(texts)] == want


def test_words_start_where_the_tokenizer_has_them():
    """Contractions, runs of white space and ends of texts, two texts at a time."""
    enc = token_store.Encoder(tokenizer_path(), 2)
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'ll", "'d", "s", "l", "e", "v", "r", " ", "  ", "\n", "\t", "\xa0", "a", "1", ".", "\u00e9", "\u65e5", "''", "S", "\x1c", "\x85"]
    words = lambda t: [t[a:b] for _, (a, b) in enc.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    for _ in range(3000):
        one, two = ("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(2))
        points = np.frombuffer((one + two).encode("utf-32-le"), "<u4")
        at = [*token_store.word_starts(points, token_store.kinds()[points], np.array([0, len(one)])).tolist(), len(points)]
        assert [(one + two)[a:b] for a, b in zip(at, at[1:])] == words(one) + words(two)


def test_white_space_runs_are_not_encoded_whole(monkeypatch):
    """Code and tables are full of spaces beside other white space; their words are remembered as all others are."""
    enc = token_store.Encoder(tokenizer_path(), 2)
    texts = [f"def f{k}():\n    return  {k}\n\n \tx = 'it''s'  " for k in range(50)]
    want, whole = [enc.whole(t) for t in texts], []
    monkeypatch.setattr(enc, "whole", lambda t: whole.append(t) or b"")
    assert enc.encode_all(texts) == want and not whole


def test_long_texts_are_cut(monkeypatch):
    """A long text takes the memory of its parts, and its ids are the same."""
    enc = token_store.Encoder(tokenizer_path(), 2)
    rng = random.Random(5)
    parts = ["word", "it's", " ", "  ", "\n", "\t ", "\xa0", ".", "\u00e9", "\u65e5\u672c", "1", "\ua7d2"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(100, 400))) for _ in range(200)] + ["x" * 300, "", " " * 200, "a<|endoftext|>b " * 30]
    want = [enc.whole(t) for t in texts]
    monkeypatch.setattr(token_store, "AT_ONCE", 40)
    some, most = enc._encode_some, []
    monkeypatch.setattr(enc, "_encode_some", lambda x: most.append(max(map(len, x), default=0)) or some(x))
    assert enc.encode_all(texts) == want and len(most) > 2000
