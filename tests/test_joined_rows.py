"""The joined plan keeps a row a chunk and distinct piece, not one a document and piece."""

import pytest

from glyphmill.functions.text import TOK_ID_OFFSET as OFF
from glyphmill.operators import codec
from tests.bruteforce import encode


@pytest.mark.parametrize("chunk", [64, 8 << 20])
def test_pieces_of_a_chunk_are_held_once(spark, monkeypatch, chunk):
    kept = {}

    def counted(df, name, *more, save=codec.save_scratch):
        out = save(df, name, *more)
        kept[name] = max(kept.get(name, 0), out.count())
        return out
    monkeypatch.setattr(codec, "save_scratch", counted)
    monkeypatch.setattr(codec, "CHUNK_BYTES", chunk, raising=False)
    rules = {(ord("a"), ord("b")): OFF, (OFF, ord("c")): OFF + 1}
    texts = ["abc ab c" * (i % 3 + 1) for i in range(300)] + [None, "", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    entries = spark.createDataFrame([(c, list(w)) for w, c in rules.items()], "code long, comps array<long>")
    got = {r.doc_id: r.tokens for r in codec.encode(docs, entries, all_legal=True, max_packed_bytes=0).collect()}
    assert got == {i: None if t is None else encode([ord(c) for c in t], rules, 2) for i, t in enumerate(texts)}
    if chunk > 64:
        assert kept["pieces"] <= 10, kept
