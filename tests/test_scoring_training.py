"""Scoring and gradients against a direct per-position NumPy evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.vectors import BIGE, SMOL
from glyphmill.operators import samples, scoring, training


def _clip(a):
    a = np.where(np.abs(a) > SMOL, a, np.where(a < 0, -SMOL, SMOL))
    return np.where(np.abs(a) < BIGE, a, np.where(a < 0, -BIGE, BIGE))


def _direct(E, U, seqs):
    """Per-position reference math for a block-free model: loss, dE, dU."""
    dE, dU, losses = np.zeros_like(E), np.zeros_like(U), []
    for s in seqs:
        x, y = s[:-1], s[1:]
        xe = E[x]
        z = xe @ U
        ex = np.exp(z)
        p = _clip(ex) / _clip(ex.sum(axis=1, keepdims=True))
        onehot = np.zeros_like(p)
        onehot[np.arange(len(y)), y] = 1.0
        losses.append(-(onehot * np.log(np.maximum(p, SMOL))).sum())
        gz = p - onehot
        dU += xe.T @ gz
        gh = gz @ U.T
        for t, tok in enumerate(x):
            dE[tok] += gh[t]
    return losses, dE, dU


def _model_tables(spark, E, U):
    emb = spark.createDataFrame([(i, E[i].tolist()) for i in range(len(E))], "idx bigint, vec array<double>")
    une = spark.createDataFrame([(v, U[:, v].tolist()) for v in range(U.shape[1])],
                                "idx bigint, vec array<double>")
    params = (emb.select(F.lit("embed").alias("tensor"), F.lit(-1).alias("block"),
                         F.col("idx").alias("row"), "vec")
              .unionByName(une.select(F.lit("unembed").alias("tensor"), F.lit(-1).alias("block"),
                                      F.col("idx").alias("row"), "vec")))
    return emb, une, params


def test_losses_and_gradients_match_direct(spark):
    rng = np.random.default_rng(5)
    V_, C = 7, 4
    E = rng.uniform(-1, 1, (V_, C))
    U = rng.uniform(-1, 1, (C, V_))
    seqs = [rng.integers(0, V_, size=n).tolist() for n in (6, 9, 2, 12)]
    losses, dE, dU = _direct(E, U, seqs)
    emb, une, params = _model_tables(spark, E, U)
    sdf = spark.createDataFrame([(i, s[:-1], s[1:]) for i, s in enumerate(seqs)],
                                "doc_id bigint, x array<bigint>, y array<bigint>")
    got = {r["doc_id"]: r["loss"] for r in scoring.sample_losses(sdf, emb, une, ["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(len(seqs))], losses)
    pairs = samples.pair_counts(sdf)
    g = {(r["tensor"], r["row"]): np.array(r["vec"])
         for r in training.batch_gradients(pairs, params).collect()}
    for v in range(V_):
        assert np.allclose(g[("unembed", v)], dU[:, v])
    seen = {t for s in seqs for t in s[:-1]}
    for tok in range(V_):
        if tok in seen:
            assert np.allclose(g[("embed", tok)], dE[tok])
        else:
            assert ("embed", tok) not in g            # sparse: only tokens seen


def test_chunked_normalizers_equal_single_chunk(spark, monkeypatch):
    rng = np.random.default_rng(9)
    V_, C = 11, 3
    E = rng.uniform(-2, 2, (V_, C))
    U = rng.uniform(-2, 2, (C, V_))
    emb, une, _ = _model_tables(spark, E, U)
    xs = spark.createDataFrame([(i,) for i in range(V_)], "x bigint")
    one = {r["x"]: (r["zsum"], r["best_idx"]) for r in scoring.normalizers(xs, emb, une).collect()}
    monkeypatch.setattr(scoring, "MAX_CHUNK_DOUBLES", 2 * C)       # 2 columns per chunk
    many = {r["x"]: (r["zsum"], r["best_idx"]) for r in scoring.normalizers(xs, emb, une).collect()}
    for x in range(V_):
        assert np.isclose(one[x][0], many[x][0]) and one[x][1] == many[x][1]
        assert one[x][1] == int(np.argmax(_clip(np.exp(E[x] @ U))))


def test_predict_next_ties_pick_lowest_id(spark):
    E = np.array([[1.0, 0.0], [0.5, 0.5]])
    U = np.array([[2.0, 2.0, 1.0], [0.0, 0.0, 0.0]])          # columns 0 and 1 tie
    emb, une, _ = _model_tables(spark, np.vstack([E, [[0.0, 0.0]]]), U)
    seqs = spark.createDataFrame([(1, [0]), (2, [2, 0])], "doc_id bigint, tokens array<bigint>")
    got = {r["doc_id"]: r["next_idx"] for r in scoring.predict_next(seqs, emb, une).collect()}
    assert got == {1: 0, 2: 0}


def test_train_one_batch_update(spark):
    rng = np.random.default_rng(2)
    V_, C, B, lr = 5, 3, 2, 0.1
    E = rng.uniform(-1, 1, (V_, C))
    U = rng.uniform(-1, 1, (C, V_))
    _, _, params = _model_tables(spark, E, U)
    seqs = {(0, 0): [1, 2, 3], (1, 0): [3, 4, 1, 1], (2, 0): [0, 0, 2]}
    per_sample = spark.createDataFrame(
        [(d, k, s[:-1], s[1:]) for (d, k), s in seqs.items()],
        "doc_id bigint, k int, x array<bigint>, y array<bigint>")
    pc = samples.pair_counts(per_sample, ["doc_id", "k"])
    bids = samples.limit_samples(per_sample.select("doc_id", "k"), 100, B)
    cfg = training.TrainConfig(batch_size=B, lr=lr, max_norm=1.0)
    new, metrics = training.train(pc, bids, params, cfg)
    m = metrics.orderBy("batch_id").collect()
    assert [r["batch_id"] for r in m] == [0, 1]          # sample 0 alone, then samples 1-2
    # replay the two updates directly
    order = [seqs[(0, 0)], seqs[(1, 0)], seqs[(2, 0)]]
    for batch in ([order[0]], order[1:]):
        _, dE, dU = _direct(E, U, batch)
        dE, dU = dE / B, dU / B
        norm = np.sqrt((dE ** 2).sum() + (dU ** 2).sum())
        c = 1.0 / max(norm, SMOL)
        if c < 1.0:
            dE, dU = dE * c, dU * c
        E, U = E - dE * lr * B, U - dU * lr * B
    got = {(r["tensor"], r["row"]): np.array(r["vec"]) for r in new.collect()}
    for i in range(V_):
        assert np.allclose(got[("embed", i)], E[i])
        assert np.allclose(got[("unembed", i)], U[:, i])


def test_init_params_shapes_and_ranges(spark):
    shape = training.ModelShape(vocab_size=10, embed_dim=8, n_blocks=1, n_heads=2, ff_dim=15)
    p = training.init_params(spark, shape, 7)
    rows = {(r["tensor"]): (r["n"], r["w"], r["lo"], r["hi"]) for r in p.groupBy("tensor").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w"),
        F.min(F.array_min("vec")).alias("lo"), F.max(F.array_max("vec")).alias("hi")).collect()}
    assert rows["embed"][:2] == (10, 8) and rows["query"][:2] == (16, 4)
    assert rows["ff1"][:2] == (8, 15) and rows["ff2"][:2] == (15, 8)
    assert rows["ln_scale"][2:] == (1.0, 1.0) and rows["ln_bias"][2:] == (0.0, 0.0)
    lim = 1 / np.sqrt(80)
    assert -lim <= rows["embed"][2] and rows["embed"][3] <= lim
    again = training.init_params(spark, shape, 7).repartition(3)
    assert p.exceptAll(again).isEmpty()                   # independent of partitioning
    with pytest.raises(ValueError):
        training.ModelShape(vocab_size=10, embed_dim=8, n_heads=3).check()


def test_unknown_ids_are_errors(spark):
    model = spark.createDataFrame([(i, [0.1 * i, 0.2]) for i in range(3)], "idx bigint, vec array<double>")
    params = model.selectExpr("'embed' tensor", "-1 block", "idx row", "vec").unionByName(
        model.selectExpr("'unembed' tensor", "-1 block", "idx row", "vec"))
    seqs = spark.createDataFrame([(1, [0, 7])], "doc_id bigint, tokens array<bigint>")
    for x, y in ((0, 7), (7, 0)):
        pairs = spark.createDataFrame([(x, y, 1)], "x bigint, y bigint, n bigint")
        with pytest.raises(Exception, match="no model row for id 7"):
            scoring.pair_terms(pairs, model, model).collect()
        with pytest.raises(Exception, match="no model row for id 7"):
            training.batch_gradients(pairs, params).collect()
    with pytest.raises(Exception, match="no model row for id 7"):
        scoring.embed_tokens(seqs, model).collect()
    with pytest.raises(Exception, match="no model row for id 7"):
        scoring.predict_next(seqs, model, model).collect()


def test_training_leaves_nothing_and_reads_the_corpus_once(spark, tmp_path):
    """Five rounds: one read of the samples' file, and only the final parameters' table stays."""
    import os
    from glyphmill.session import checkpoint_dir
    rng = np.random.default_rng(0)
    rows = [(i, [int(v) for v in rng.integers(0, 6, 12)]) for i in range(9)]
    path = str(tmp_path / "enc.parquet")
    spark.createDataFrame(rows, "doc_id bigint, tokens array<bigint>").write.parquet(path)
    wins = samples.sample_windows(spark.read.parquet(path), 100, 1)
    ids = samples.limit_samples(wins.select("doc_id", "k"), None, 2)
    pc = samples.pair_counts(wins, ["doc_id", "k"])
    params = training.init_params(spark, training.ModelShape(vocab_size=6, embed_dim=8), 3)
    base = checkpoint_dir(spark).split(":", 1)[-1]
    before = {f for f in os.listdir(base) if f.startswith("glyphmill-")}
    out, metrics = training.train(pc, ids, params, training.TrainConfig(batch_size=2), val_pairs=samples.pair_counts(
        samples.validation_set(spark.read.parquet(path), 10, 5, 1), ["doc_id"]))
    assert metrics.count() == 5
    left = {f for f in os.listdir(base) if f.startswith("glyphmill-")} - before
    assert len(left) == 1 and out.count() == 12
    assert path not in out._jdf.queryExecution().toString()
