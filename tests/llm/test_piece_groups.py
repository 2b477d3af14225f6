"""A group of texts asks the tokenizer once for each distinct piece, however small the cache."""

import itertools

import numpy as np

from glyphmill.llm import packing
from glyphmill.llm.queries import tokenizer_path


def test_a_piece_is_encoded_once(monkeypatch):
    asked = []

    def counted(self, pieces, codes=packing.PieceTokenizer._codes):
        asked.extend(pieces)
        return codes(self, pieces)
    monkeypatch.setattr(packing, "CACHED", 50)
    monkeypatch.setattr(packing.PieceTokenizer, "_codes", counted)
    letters = ["".join(x) for x in itertools.product("abcdefghij", repeat=3)]
    texts = [" ".join(f"{first}{w}" for w in letters) * 210 + " <Été, 12>" for first in ("k", "l", "m", "k")]
    assert all(len(t) > 1 << 20 for t in texts)
    tokenizer = packing.PieceTokenizer(tokenizer_path())
    got = list(tokenizer.encode([t.encode() for t in [*texts, "", "x <|endoftext|> y"]]))
    for text, ids in zip(texts, got, strict=False):
        assert np.array_equal(ids, tokenizer._whole(text))
    assert len(got[4]) == 0 and np.array_equal(got[5], tokenizer._whole("x <|endoftext|> y"))
    assert len(asked) == len(set(asked))
