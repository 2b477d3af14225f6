"""Windows, ids and the validation set made from texts are those made from arrays of character codes."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.text import char_codes
from glyphmill.operators import codec, samples
from glyphmill.plans import queries


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    odd = ["", "a", "ab", "\U0001f600é", "x" * 10, "ab" * 5 + "c", "\U0001f600" * 25, "tab\tnew\nline"]
    rows = list(enumerate(odd)) + [(20 + i, "".join(rng.choices("abcdeé \U0001f600", k=rng.randint(1, 95)))) for i in range(60)]
    rows += [(21, "the same id, another text"), (21, "xy" * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()


def rows_of(df):
    return sorted((r.doc_id, r.k, r.start_idx, r.sample_len, tuple(sorted(zip(r.xs, r.ys, r.ns, strict=True)))) for r in df.collect())


@pytest.mark.parametrize("size", [1, 2, 10, 1000])
@pytest.mark.parametrize("small", [False, True])
def test_windows(spark, texts, size, small):
    toks = texts.select("doc_id", char_codes(F.col("text")).alias("tokens"))
    ids = codec.model_vocab(toks)
    want = rows_of(samples.window_pairs(samples.sample_windows(toks, size, 7), ids))
    wide = ids.select("code", (F.col("tok_idx") * (1 if small else 30_000_000)).alias("tok_idx"))   # ids above the reach of 32-bit keys
    got = [(*r[:4], tuple((x // (1 if small else 30_000_000), y // (1 if small else 30_000_000), n) for x, y, n in r[4]))
           for r in rows_of(samples.text_window_pairs(texts, wide, size, 7))]
    assert got == want and (size == 1 or len(want) > 60)


def test_ids_and_validation_set(texts):
    toks = texts.select("doc_id", char_codes(F.col("text")).alias("tokens"))
    assert codec.model_vocab(texts, "text").collect() == codec.model_vocab(toks).collect()
    want, got = samples.validation_set(toks, 50, 20, 3), samples.validation_set(texts, 50, 20, 3, "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5


def test_a_character_without_an_id(texts):
    ids = codec.model_vocab(texts, "text").filter("code <> 97")
    with pytest.raises(Exception, match="token code without a model id"):
        samples.text_window_pairs(texts, ids, 10, 7).collect()


def test_training_makes_no_arrays_of_codes(spark):
    per_sample, batch_ids, _, val = queries._training_set(spark, "/root/testdata/sf0.001")
    for df in (per_sample, batch_ids, val):
        assert "split(text" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = samples.text_window_pairs(queries._docs(spark, "/root/testdata/sf0.001"),
                                     codec.model_vocab(queries._docs(spark, "/root/testdata/sf0.001"), "text"), 1000, 7)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("length(text") == 1          # not once a draw: a long text has many
