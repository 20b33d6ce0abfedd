import random

import pytest

from codeloom.llm import tokens

PIECES = ["word", " ", "  ", "\n", "\r\n", "\t", "'ll", "'", "don't", "12", "é", "漢字", "👍", "<|endoftext|>", "a" * 50, "=", "-->", " ", "​", "x1y2"]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 16])
def test_tree_equals_whole_text(leaf):
    encoding, rng = tokens.encoder(), random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert tokens.encode(text, encoding, leaf=leaf, window=rng.choice([1, 2, 8])) == encoding.encode_ordinary(text)


def test_round_trip_and_empty():
    encoding = tokens.encoder()
    assert tokens.encode("", encoding) == [] and tokens.encode(None, encoding) == []
    text = "Ünïcode 👍 " * 5000
    assert tokens.decode(tokens.encode(text, encoding), encoding) == text
