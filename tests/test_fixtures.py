"""The reference's inline tokenizer tests, on one-row tables."""

from pyspark.sql import functions as F

from glyphmill.operators import codec, nseq
from glyphmill.operators.vocab import train_vocab
from glyphmill.sources import vocab_io

SENTENCE = ("Litwo, ojczyzno moja, Ty jesteś jak zdrowie. Ile Cię trzeba cenić, "
            "ten tylko się dowie, kto Cię stracił.")


def test_rabarbar_most_common_trigram(one_doc):
    rows = nseq.nseq_counts(one_doc("rabarbar"), 3).collect()
    assert [(r["nseq"], r["cnt"]) for r in rows] == [("bar", 2)]
    top = nseq.top_nseqs(one_doc("rabarbar"), 3, 1).collect()
    assert (top[0]["nseq"], top[0]["cnt"]) == ("bar", 2)


def test_blablabl_respects_vocab_size(one_doc):
    counts = {r["nseq"]: r["cnt"] for r in nseq.nseq_counts(one_doc("blablabl"), 2).collect()}
    assert counts == {"bl": 3, "la": 2, "ab": 2}
    v, report = train_vocab(one_doc("blablabl"), 2, 2)
    rep = report.collect()
    assert sum(r["new_tokens"] for r in rep) == 2 and rep[-1]["full"]
    assert v.comps == {1114112: (98, 108), 1114113: (108, 97)}
    assert v.texts == {1114112: "bl", 1114113: "la"}


def test_sentence_roundtrip(one_doc):
    v, _ = train_vocab(one_doc(SENTENCE), 2, 50)
    enc = codec.encode(one_doc(SENTENCE), v)
    back = codec.decode(enc, v, "tokens", "back").collect()[0]
    assert back["back"] == SENTENCE
    assert len(back["tokens"]) < len(SENTENCE)


def test_import_export_equal(spark, one_doc, tmp_path):
    v, _ = train_vocab(one_doc(SENTENCE), 2, 50)
    path = str(tmp_path / "tok.json")
    vocab_io.export_vocab(v, path)
    back = vocab_io.import_vocab(spark, path)
    assert back.comps == v.comps and back.texts == v.texts
    assert back.n == 2 and back.vocab_size == 50 and back.next_free_id == v.next_free_id
    import pytest
    with pytest.raises(FileExistsError):
        vocab_io.export_vocab(v, path)


def test_export_json_shape(spark, one_doc):
    import json
    v, _ = train_vocab(one_doc("blablabl"), 2, 2)
    doc = json.loads(vocab_io.vocab_json(v.to_df(spark), 2, 2).first()["json"])
    assert doc == {"n": 2, "vocab_size": 2, "tokens": {"1114112": [98, 108], "1114113": [108, 97]}}


def test_edge_texts(docs):
    df = docs(["", None, "x", "aaa", "a\n", "12345", "a\U0001F600b", "  "]).filter(
        F.col("text").isNotNull())
    got = {(r["nseq"]) : r["cnt"] for r in nseq.nseq_counts(df, 2, min_count=1).collect()}
    assert got["aa"] == 2                    # overlapping windows
    assert "a\n" not in got                  # trailing newline is not a legal token
    assert "12" in got and "  " in got
    assert "a\U0001F600" not in got and "\U0001F600b" not in got
    tri = {r["nseq"] for r in nseq.nseq_counts(df, 3, min_count=1).collect()}
    assert "123" in tri and "234" in tri
    four = {r["nseq"] for r in nseq.nseq_counts(df, 4, min_count=1).collect()}
    assert "1234" not in four                # at most three numerals per token
