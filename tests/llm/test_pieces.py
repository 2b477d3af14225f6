"""The piece cache gives the tokenizer's own ids of whole texts."""

import random

from glyphmill.llm import packing
from glyphmill.llm.queries import tokenizer_path

ALPHABET = list("abcXYZ'sStTrRevVmMlLdD0129 .,!?-_\t\n\x1c\x1f\x00\x7f\x85\xa0éÉßÿÀ×÷İſςΣñ中文²½<|>") + ["́", "­"]


def test_ids_of_whole_texts():
    draw = random.Random(11)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "a" * 300, "Ünïcode's IT'S 12,345.67 don't", "x<|endoftext|>y", "é" * 100 + "x " * 50]
    words = packing.PieceTokenizer(tokenizer_path())
    for _ in range(2):  # with an empty and with a filled cache
        for text, ids in zip(texts, words.encode([t.encode() for t in texts], most=4000), strict=True):
            assert words.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 50)
    words = packing.PieceTokenizer(tokenizer_path())
    texts = [f"w{'abcdefghij'[i % 10] * (i + 1)} {'z' * (i + 1)}" for i in range(120)]
    got = list(words.encode([t.encode() for t in texts], most=100))
    assert [g.tolist() for g in got] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.cache) <= 60 and len(words.older) <= 60
    assert max(map(len, [*words.cache, *words.older])) <= packing.LONGEST
