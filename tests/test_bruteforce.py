"""Training and encoding against the direct restatement on small fixtures."""

import random

import pytest

from glyphmill.functions.text import TOK_ID_OFFSET
from glyphmill.operators import codec
from glyphmill.operators.vocab import train_vocab

from bruteforce import encode, train

ALPHABET = list("ab ba.,1234 \t\nxyzé😀") + ["  "]


def _rand_text(rng, k):
    return "".join(rng.choice(ALPHABET) for _ in range(k))


CASES = ["blablabl", "rabarbar", "aaaa aaaa aaaa", "12345 12345 123",
         "Litwo, ojczyzno moja, Ty jesteś jak zdrowie. Ile Cię trzeba cenić, ten tylko się dowie, "
         "kto Cię stracił."]


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("cap", [3, 50])
def test_train_one_doc_matches_direct(one_doc, n, cap):
    rng = random.Random(n * 100 + cap)
    texts = CASES + [_rand_text(rng, 60) for _ in range(4)]
    for text in texts:
        tokens, ttexts = train(text, n, cap)
        v, rep = train_vocab(one_doc(text), n, cap)
        assert v.comps == {code: w for w, code in tokens.items()}, text
        assert v.texts == ttexts, text
        assert sum(r["new_tokens"] for r in rep.collect()) == len(tokens)
        assert v.full == (len(tokens) >= cap)
        enc = codec.encode(one_doc(text), v).first()["tokens"]
        assert enc == encode([ord(c) for c in text], tokens, n), text


def test_multi_doc_equals_separated_concatenation(docs, one_doc):
    # Corpus scope = one document made of the rows joined by an uncrossable cut.
    rows = ["the cat sat", "the hat", "that cat"]
    v, _ = train_vocab(docs(rows), 2, 100)
    tokens, ttexts = train("\n".join(rows), 2, 100)
    assert set(v.texts.values()) == set(ttexts.values())
    assert len(v.comps) == len(tokens)


def test_encode_independent_of_partitioning(spark, docs):
    rng = random.Random(7)
    texts = [_rand_text(rng, rng.randint(0, 80)) for _ in range(60)]
    v, _ = train_vocab(docs(texts), 2, 40)
    a = {r["doc_id"]: r["tokens"] for r in codec.encode(docs(texts).repartition(1), v).collect()}
    b = {r["doc_id"]: r["tokens"] for r in codec.encode(docs(texts).repartition(7), v).collect()}
    assert a == b
    table = v.table()
    for i, t in enumerate(texts):
        assert a[i] == encode([ord(c) for c in t], table, 2)
        assert all(c < TOK_ID_OFFSET or c in v.comps for c in a[i])


def test_vocab_properties_on_documents(spark):
    from glyphmill.sources.corpus import read_corpus
    from glyphmill.operators.vocab import vocab_legality
    c = read_corpus(spark, "/root/testdata/sf0.001/documents.parquet")
    v, rep = train_vocab(c, 2, 300)
    assert v.count == 300 and v.full
    assert len(set(v.texts.values())) == v.count          # texts unique
    assert sorted(v.comps) == list(range(TOK_ID_OFFSET, TOK_ID_OFFSET + 300))   # dense ids
    assert vocab_legality(v.to_df(spark)).isEmpty()        # every token legal
    rt = codec.decode(codec.encode(c, v), v, "tokens", "back")
    assert rt.filter("back <> text").isEmpty()
