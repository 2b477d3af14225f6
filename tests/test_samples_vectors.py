"""Windows, global index, batches; vector formulas and guards."""

import math

import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions import vectors as V
from glyphmill.operators import samples, vector_ops


def test_windows_per_doc_and_starts(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [5]), (3, []), (4, list(range(25)))],
                               "doc_id bigint, tokens array<bigint>")
    w = samples.sample_windows(df, sample_size=10, seed=3).collect()
    by = {}
    for r in w:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 1 and by[1][0]["start_idx"] == 0          # len == sample: start 0
    assert 2 not in by and 3 not in by                              # length-1 / empty dropped
    assert len(by[4]) == 3                                          # ceil(25 / 10)
    for r in by[4]:
        assert 0 <= r["start_idx"] < 15                             # exclusive upper end
        assert r["x"] == list(range(r["start_idx"], r["start_idx"] + 9))
        assert r["y"] == list(range(r["start_idx"] + 1, r["start_idx"] + 10))


def test_global_index_skewed_keys(spark):
    ids = list(range(0, 3000)) + [10 ** 15, 10 ** 15 + 7] + list(range(5000, 5003))
    rows = [(i, (i % 5) + 1) for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, w bigint").repartition(5)
    got = {r["doc_id"]: r["_offset"]
           for r in samples.global_index(df, ["doc_id"], "w").collect()}
    run = 0
    for i, w in sorted(rows):
        assert got[i] == run
        run += w


def test_limit_and_batches(spark):
    df = spark.createDataFrame([(d, k) for d in range(5) for k in range(d + 1)],
                               "doc_id bigint, k int")
    out = samples.limit_samples(df, n_samples=12, batch_size=4).orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(12))
    order = sorted([(d, k) for d in range(5) for k in range(d + 1)])[:12]
    assert [(r["doc_id"], r["k"]) for r in out] == order
    assert [r["batch_id"] for r in out] == [0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3]
    assert [r["complete"] for r in out] == [True] * 9 + [False] * 3


def test_softmax_guard(spark):
    df = spark.createDataFrame([([2.449346e24, float("-inf")],)], "v array<double>")
    p = df.select(V.softmax(F.col("v")).alias("p")).first()["p"]
    assert all(math.isfinite(x) and not math.isnan(x) for x in p)


def test_clip_magnitude_cases(spark):
    vals = [0.0, 1e-9, -1e-9, 5.0, -5.0, 1e39, -1e39, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(V.clip_magnitude(F.col("x"))).collect()]
    assert got[0] == V.SMOL and got[1] == V.SMOL and got[2] == -V.SMOL
    assert got[3] == 5.0 and got[4] == -5.0
    assert got[5] == V.BIGE and got[6] == -V.BIGE and got[7] == V.SMOL


def test_gelu_layernorm_against_numpy(spark):
    rng = np.random.default_rng(1)
    vecs = rng.uniform(-5, 5, size=(42, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "i int, v array<double>")
    out = df.select("i", V.gelu(F.col("v")).alias("g"), V.gelu_grad(F.col("v")).alias("gg"),
                    V.layer_norm(F.col("v")).alias("ln")).orderBy("i").collect()
    for r, x in zip(out, vecs):
        g = x * (1.0 / (1.0 + np.exp(-1.702 * x)))
        s = 1.0 / (1.0 + np.exp(1.702 * x))
        gg = s * (1.0 + 1.702 * x * (1.0 - s))
        ln = x - x.mean() / np.sqrt(x.var() + V.SMOL)
        assert np.allclose(r["g"], g) and np.allclose(r["gg"], gg) and np.allclose(r["ln"], ln)


def test_vector_sum_norm_clip_update(spark):
    rows = [("embed", -1, i % 3, [float(i), 1.0, -2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "tensor string, block int, row bigint, vec array<double>")
    s = {r["row"]: r["vec"] for r in vector_ops.sum_vectors(df, ["tensor", "block", "row"]).collect()}
    assert s[0] == [9.0, 3.0, -6.0] and s[1] == [12.0, 3.0, -6.0]
    norm = vector_ops.global_l2_norm(df).first()["norm"]
    assert math.isclose(norm, math.sqrt(sum(i * i + 5 for i in range(9))))
    clipped = vector_ops.clip_by_norm(df, 1.0)
    assert math.isclose(vector_ops.global_l2_norm(clipped).first()["norm"], 1.0)
    grads = spark.createDataFrame([("embed", -1, 0, [1.0, 1.0, 1.0])],
                                  "tensor string, block int, row bigint, vec array<double>")
    params = vector_ops.sum_vectors(df, ["tensor", "block", "row"])
    upd = {r["row"]: r["vec"] for r in vector_ops.apply_update(params, grads, 0.5).collect()}
    assert upd[0] == [8.5, 2.5, -6.5] and upd[1] == [12.0, 3.0, -6.0]


def test_string_keys_and_excluded_validation(spark):
    rows = [(f"d{i:03d}", list(range(i % 7 + 2))) for i in range(40)]
    enc = spark.createDataFrame(rows, "url string, tokens array<bigint>")
    wins = samples.sample_windows(enc, 4, 1, keys=["url"])
    idx = samples.limit_samples(wins, None, 3, keys=["url"]).orderBy("i").collect()
    assert [r["i"] for r in idx] == list(range(len(idx)))
    assert [(r["url"], r["k"]) for r in idx] == sorted((r["url"], r["k"]) for r in idx)
    val = samples.validation_set(enc, 20, 4, 1, keys=["url"])
    assert val.count() == 2
    rest = samples.exclude_validation(enc, val, ["url"])
    assert rest.count() == 38 and rest.join(val, "url").isEmpty()


def test_sample_summary(spark):
    enc = spark.createDataFrame([(1, [5]), (2, [1, 2, 3]), (3, [])], "doc_id bigint, tokens array<bigint>")
    wins = samples.sample_windows(enc, 4, 1, keep_short=True)
    assert tuple(samples.sample_summary(wins, 10).first()) == (1, 1, True)
    assert tuple(samples.sample_summary(wins, 1).first()) == (1, 1, False)
