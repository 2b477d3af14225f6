"""Packed vocabularies, the encoder's two plans, doubling and peeling, and what a training round counts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bruteforce import OFF, encode, train
from glyphmill.operators import codec, packed
from glyphmill.operators.vocab import (
    Vocab, _initial_segments, _replaced, cyclic_entries, resolve_vocab, round_candidates, train_vocab, validate_vocab)

ALPHABET = list("ab ba.,1234 \t\nxyzé😀") + ["  "]


def rand_texts(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", "a" * 500, "ab" * 300]


def test_lookup_of_colliding_and_missing_windows():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (20_000, 3)), axis=0)
    table = packed.Packed(keys, np.arange(len(keys)), 3)
    assert (table.lookup(keys) == np.arange(len(keys))).all()
    other = keys + 1000
    assert (table.lookup(other) == -1).all()
    assert table.keys.nbytes + table.codes.nbytes == packed.packed_bytes(len(keys), 3)
    assert (packed.Packed(np.zeros((0, 2)), np.zeros(0, np.int64), 2).lookup(keys[:, :2]) == -1).all()


@pytest.mark.parametrize("n", [2, 3, 4])
def test_leftmost_picks(n):
    rng = random.Random(n)
    for _ in range(300):
        starts = sorted(rng.sample(range(60), rng.randint(0, 40)))
        want, free = [], 0
        for s in starts:
            want.append(s >= free)
            free = s + n if s >= free else free
        assert packed.pick_leftmost(np.array(starts, np.int64), n).tolist() == want


@pytest.mark.parametrize("n", [2, 3])
def test_flat_passes_equal_direct_encoding(n):
    texts = rand_texts(n, 80)
    vocab, _ = train("\n".join(texts), n, 60)
    table = packed.Packed(np.array(list(vocab), np.int64), np.array(list(vocab.values()), np.int64), n)
    got = packed.encode_pieces(pa.array([[t] for t in texts] + [None, []]), table).to_pylist()
    assert got == [encode([ord(c) for c in t], vocab, n) for t in texts] + [None, []]


@pytest.mark.parametrize("legal", [True, False])
def test_both_plans_of_a_vocabulary_table(spark, legal):
    texts = [*rand_texts(5, 40), None]
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pos string")
    rules, _ = train("\n".join(t for t in texts if t), 2, 50)
    if not legal:
        rules = {**rules, (ord("b"), ord(" ")): OFF + 900, (OFF + 900, ord("a")): OFF + 901}
    rows = [(code, list(w)) for w, code in rules.items()]
    entries = spark.createDataFrame(rows, "code long, comps array<long>")
    want = sorted((str(r.doc_id), str(r.text), str(None if r.text is None else encode([ord(c) for c in r.text], rules, 2)))
                  for r in docs.collect())
    for most in (codec.MAX_PACKED_BYTES, 0):
        out = codec.encode(docs, entries, max_packed_bytes=most)
        assert out.columns == ["doc_id", "text", "pos", "tokens"]
        assert sorted((str(r.doc_id), str(r.text), str(r.tokens)) for r in out.collect()) == want
    none = codec.encode(docs, entries.limit(0), all_legal=True).filter("text IS NOT NULL").collect()
    assert all(r.tokens == [ord(c) for c in r.text] for r in none)
    with pytest.raises(ValueError):
        codec.encode(docs, spark.createDataFrame([(OFF, [1, 2]), (OFF + 1, [1])], "code long, comps array<long>"), all_legal=True)


def test_joined_plan_on_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    entries = spark.createDataFrame([(OFF, [97, 98])], "code long, comps array<long>")
    assert codec.encode(docs, entries, all_legal=True, max_packed_bytes=0).collect() == []


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(codec, "SLICE_ELEMENTS", 5)
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "x": [[1] * n if n is not None else None for n in (0, 2, 3, 9, None, 5, 0, 1)]})
    parts = list(codec._slices(batch, "x"))
    assert [r for p in parts for r in p.column("i").to_pylist()] == list(range(8))
    assert [p.num_rows for p in parts] == [3, 1, 3, 1]


def test_map_tokens(spark):
    df = spark.createDataFrame([(1, [5, 9, 5]), (2, []), (3, None)], "doc_id long, tokens array<long>")
    ids = spark.createDataFrame([(5, 0), (7, 1), (9, 2)], "code long, tok_idx int")
    assert {r.doc_id: r.tokens for r in codec.map_tokens(df, ids).collect()} == {1: [0, 2, 0], 2: [], 3: None}
    with pytest.raises(Exception, match="without a model id"):
        codec.map_tokens(df, ids.filter("code < 9")).collect()


def test_doubling_takes_the_logarithm_of_the_depth(spark):
    chain = [(OFF + i, [OFF + i - 1 if i else 97, 98 + i % 3]) for i in range(100)]
    rounds = []
    got = {r.code: r for r in resolve_vocab(spark.createDataFrame(chain, "code long, comps array<long>"), rounds).collect()}
    text = display = ""
    for i in range(100):
        text = (text or "a") + chr(98 + i % 3)
        display = f"{i}=({display or 'a'}|{chr(98 + i % 3)})"
        assert (got[OFF + i].unrolled, got[OFF + i].display) == (text, display)
    assert len(rounds) <= 8


def test_resolution_of_branching_entries(spark):
    rng = random.Random(9)
    v = Vocab(3, 100)
    for i in range(60):
        pick = lambda i=i: rng.choice([ord(rng.choice("añ😀|=(")), *([OFF + rng.randrange(i)] * 2 if i else [])])
        comps = (pick(), pick(), pick())
        text = "".join(v.texts.get(c) or chr(c) for c in comps)
        if len(text) < 400:
            v.add(comps, text)
        else:
            v.add((97, 98, 99), "abc")
    got = {r.code: (r.unrolled, r.display) for r in resolve_vocab(v.to_df(spark).select("code", "comps")).collect()}
    assert got == {c: (v.texts[c], v.display(c)) for c in v.comps}


def test_cycles_and_what_is_behind_them(spark):
    rows = [(0, [97, 98]), (1, [OFF, 99]),                            # fine
            (2, [OFF + 3, 97]), (3, [OFF + 4, 97]), (4, [OFF + 2, 97]),   # a cycle of three
            (5, [OFF + 5, OFF + 5]),                                  # of itself, twice
            (6, [OFF + 2, OFF + 1]), (7, [97, OFF + 6]),              # behind
            (8, [OFF + 99, 97]), (9, [OFF + 8, OFF + 1])]             # undefined, and behind an undefined one
    entries = spark.createDataFrame([(OFF + i, c) for i, c in rows], "code long, comps array<long>")
    assert sorted(r.code - OFF for r in cyclic_entries(entries).collect()) == [2, 3, 4, 5, 6, 7]
    bad = {(r.code - OFF, r.problem) for r in validate_vocab(entries, 2).collect()}
    assert bad == {(i, "on or behind a cycle") for i in (2, 3, 4, 5, 6, 7)} | {(8, f"undefined component {OFF + 99}")}
    with pytest.raises(ValueError, match="undefined"):
        resolve_vocab(entries)
    with pytest.raises(ValueError, match="cyclic"):
        resolve_vocab(entries.filter(f"code < {OFF + 8}"))


@pytest.mark.parametrize("n", [2, 3])
def test_rounds_count_new_windows_only(spark, n):
    """A round's candidates equal those of a recount of all windows of the encoded corpus; the counted windows fall."""
    texts = [t * 2 for t in rand_texts(20 + n, 60)] + ["abababab xyxyxyx", "aaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v, report = train_vocab(docs, n, 10_000)
    rounds = report.orderBy("round").collect()
    assert len(rounds) >= 3 and rounds[-1].new_tokens == 0
    assert all(b.windows < a.windows for a, b in zip(rounds, rounds[1:], strict=False))
    done = Vocab(n, 10_000)
    for r in rounds:
        segs = _initial_segments(docs, n)
        if done.count:
            segs = _replaced(segs, done.pack(), repeat=True, changed_only=False)
        known = spark.createDataFrame([(t,) for t in done.texts.values()], "unrolled string")
        whole = round_candidates(segs, known, n, None).collect()
        assert [tuple(x.comps) for x in whole] == [v.comps[OFF + done.count + i] for i in range(r.new_tokens)]
        for x in whole:
            done.add(tuple(x.comps), x.unrolled)
    assert done.comps == v.comps


@pytest.mark.parametrize("n", [2, 3])
def test_training_goes_on_from_a_capped_vocabulary(one_doc, n):
    text = "\n".join(t * 2 for t in rand_texts(31, 30))
    part, _ = train_vocab(one_doc(text), n, 15)
    begun = train(text, n, 15)
    assert part.comps == {code: w for w, code in begun[0].items()}
    part.vocab_size = 10_000
    more, _ = train_vocab(one_doc(text), n, 10_000, vocab=part)
    tokens, texts = train(text, n, 10_000, begun)
    assert more.count > 15 and more.texts == texts and more.comps == {code: w for w, code in tokens.items()}
