"""Invalid vocabularies, null policies, output guards, parameter output, NaN/inf checks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import training, vector_ops
from glyphmill.operators.vocab import Vocab, resolve_vocab, validate_vocab
from glyphmill.sources import corpus, vocab_io


def _write_json(tmp_path, doc, name="v.json"):
    p = tmp_path / name
    p.write_text(json.dumps(doc))
    return str(p)


def test_import_nested_resolves_and_displays(spark, tmp_path):
    path = _write_json(tmp_path, {"n": 2, "vocab_size": 5,
                                  "tokens": {"1114112": [98, 108], "1114113": [1114112, 97]}})
    v = vocab_io.import_vocab(spark, path)
    assert v.texts == {1114112: "bl", 1114113: "bla"}
    assert v.display(1114113) == "1=(0=(b|l)|a)"
    assert v.next_free_id == 2
    rows = {r["code"]: r["display"] for r in resolve_vocab(
        v.to_df(spark).select("code", "comps")).collect()}
    assert rows[1114113] == "1=(0=(b|l)|a)"


@pytest.mark.parametrize("tokens, word", [
    ({"1114112": [1114999, 97]}, "undefined"),
    ({"1114112": [55296, 97]}, "scalar"),
    ({"1114112": [97]}, "arity"),
])
def test_import_rejects_invalid(spark, tmp_path, tokens, word):
    path = _write_json(tmp_path, {"n": 2, "vocab_size": 5, "tokens": tokens})
    with pytest.raises(ValueError, match=word):
        vocab_io.import_vocab(spark, path)


def test_validate_lists_every_problem(spark):
    entries = spark.createDataFrame(
        [(1114112, [1114999, 97]), (1114113, [55296, 97]), (1114114, [97, 98, 99])],
        "code bigint, comps array<bigint>")
    probs = {r["code"]: r["problem"] for r in validate_vocab(entries, 2).collect()}
    assert set(probs) == {1114112, 1114113, 1114114}


def test_illegal_imported_entry_encodes_whole_document(spark, tmp_path):
    from glyphmill.operators import codec
    # "a " is not a legal token (space after a letter): segments would be unsafe
    path = _write_json(tmp_path, {"n": 2, "vocab_size": 5, "tokens": {"1114112": [97, 32]}})
    v = vocab_io.import_vocab(spark, path)
    assert not v.all_legal
    df = spark.createDataFrame([(1, "a a b")], "doc_id bigint, text string")
    assert codec.encode(df, v).first()["tokens"] == [1114112, 1114112, 98]


def test_null_policies(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, None), (4, "d")]
    p = str(tmp_path / "c.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(p)
    skip = sorted(r["doc_id"] for r in corpus.read_corpus(spark, p).collect())
    stop = sorted(r["doc_id"] for r in corpus.read_corpus(spark, p, nulls="stop").collect())
    assert skip == [1, 2, 4] and stop == [1, 2]


def test_write_params_and_guard(spark, tmp_path):
    shape = training.ModelShape(vocab_size=4, embed_dim=4, n_heads=2)
    p = training.init_params(spark, shape, 1)
    out = training.write_params(p, str(tmp_path / "ckpt"), 3)
    assert out.endswith("round=000003")
    assert spark.read.parquet(out).count() == 8
    with pytest.raises(Exception):
        training.write_params(p, str(tmp_path / "ckpt"), 3)
    with pytest.raises(FileExistsError):
        corpus.check_output(spark, out, "errorifexists")


def test_validate_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, float("nan")]), ("b", [math.inf, 0.0]), ("c", [1.0, 2.0])],
                               "k string, vec array<double>")
    with pytest.raises(ValueError, match="NaN"):
        vector_ops.validate_vectors(df, ["k"], check_inf=False)
    vector_ops.validate_vectors(df.filter(F.col("k") == "c"), ["k"])
    counts = {r["k"]: (r["n_nan"], r["n_inf"]) for r in vector_ops.vector_validity(df, ["k"]).collect()}
    assert counts == {"a": (1, 0), "b": (0, 1), "c": (0, 0)}


def test_train_refuses_block_tensors(spark):
    shape = training.ModelShape(vocab_size=4, embed_dim=4, n_blocks=1, n_heads=2, ff_dim=3)
    p = training.init_params(spark, shape, 1)
    empty = spark.createDataFrame([], "doc_id bigint, k int, x bigint, y bigint, n bigint")
    ids = spark.createDataFrame([], "doc_id bigint, k int, batch_id bigint, complete boolean")
    with pytest.raises(ValueError, match="attention blocks"):
        training.train(empty, ids, p, training.TrainConfig())


def _chain(depth):
    """Token i = token i-1 followed by 'a'."""
    return [(1114112, [97, 97])] + [(1114112 + i, [1114111 + i, 97]) for i in range(1, depth)]


def test_deep_vocabulary_resolves(spark, tmp_path):
    depth = 30
    entries = spark.createDataFrame(_chain(depth), "code bigint, comps array<bigint>")
    got = {r["code"]: r["unrolled"] for r in resolve_vocab(entries).collect()}
    assert got == {1114112 + i: "a" * (i + 2) for i in range(depth)}


def test_cycle_is_an_error(spark):
    entries = spark.createDataFrame([(1114112, [1114113, 97]), (1114113, [1114112, 97])],
                                    "code bigint, comps array<bigint>")
    with pytest.raises(ValueError, match="unresolvable"):
        resolve_vocab(entries)


def test_table_form_round_trip_and_key_range(spark, tmp_path, one_doc):
    from glyphmill.operators.vocab import train_vocab
    v, _ = train_vocab(one_doc("the cat sat on the mat, the hat"), 2, 20)
    path = str(tmp_path / "vocab.parquet")
    vocab_io.export_vocab_table(v, path)
    back = vocab_io.import_vocab_table(spark, path, 2, 20)
    assert (back.comps, back.texts, back.next_free_id) == (v.comps, v.texts, v.next_free_id)
    with pytest.raises(Exception):
        vocab_io.export_vocab_table(v, path)
    bad = _write_json(tmp_path, {"n": 2, "vocab_size": 5, "tokens": {"97": [98, 99]}})
    with pytest.raises(ValueError, match="below the token range"):
        vocab_io.import_vocab(spark, bad)


def test_windows_over_segment_borders(one_doc):
    from glyphmill.operators import nseq
    got = {r["nseq"]: r["cnt"] for r in nseq.nseq_counts(one_doc("a b a b"), 2, min_count=1, legal_only=False).collect()}
    assert got == {"a ": 2, " b": 2, "b ": 1, " a": 1}
