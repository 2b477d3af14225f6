"""Training that goes on from its commit log, and capped samples that read a part of the files."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.text import char_codes
from glyphmill.operators import samples, training
from glyphmill.sources.corpus import read_corpus


@pytest.fixture
def training_set(spark):
    rng = random.Random(5)
    pairs = [(d, 0, rng.randrange(6), rng.randrange(6), rng.randint(1, 3)) for d in range(9) for _ in range(4)]
    merged = spark.createDataFrame(pairs, "doc_id long, k int, x long, y long, n long").groupBy("doc_id", "k", "x", "y").agg(F.sum("n").alias("n"))
    ids = spark.createDataFrame([(d, 0, -(-d // 2), True) for d in range(9)], "doc_id long, k int, batch_id long, complete boolean")
    params = training.init_params(spark, training.ModelShape(vocab_size=6, embed_dim=4, n_heads=2), 3)
    return merged, ids, params


def rows_of(params):
    return {(r.tensor, r.row): list(r.vec) for r in params.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k], strict=True))


def metrics_of(df):
    return {r.batch_id: [r.avg_loss, r.min_loss, r.max_loss, r.n_samples, r.grad_norm] for r in df.collect()}


@pytest.mark.parametrize(("every", "stop"), [(1, 2), (2, 3)])
def test_resumed_training_equals_one_run(spark, training_set, tmp_path, every, stop):
    plain = training.TrainConfig(batch_size=2, lr=0.1)
    want, want_metrics = training.train(*training_set, plain)
    cfg = replace(plain, checkpoint_every=every, output_dir=str(tmp_path / "run"), resume=True)
    training.train(*training_set, replace(cfg, max_batches=stop))
    assert training.last_commit(spark, cfg) == (stop // every) * every - 1
    # a run that ended between the parameters' write and the log entry leaves a folder without an entry
    training.write_params(training_set[2].limit(1), cfg.output_dir, training.last_commit(spark, cfg) + every)
    params, metrics = training.train(*training_set, cfg)
    close(rows_of(params), rows_of(want))
    close(metrics_of(metrics), metrics_of(want_metrics))
    again, metrics = training.train(*training_set, cfg)          # nothing is left but what no entry holds
    close(rows_of(again), rows_of(want))
    close(metrics_of(metrics), metrics_of(want_metrics))


def test_log_of_another_configuration(spark, training_set, tmp_path):
    cfg = training.TrainConfig(batch_size=2, lr=0.1, checkpoint_every=1, output_dir=str(tmp_path / "run"), resume=True, max_batches=1)
    assert training.last_commit(spark, cfg) is None
    training.train(*training_set, cfg)
    with pytest.raises(ValueError, match="lr=0.1"):
        training.train(*training_set, replace(cfg, lr=0.2))


def codes(corpus):
    return corpus.select("doc_id", char_codes(F.col("text")).alias("tokens"))


def write_files(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("overlap", [False, True])
def test_capped_samples_equal_the_whole_plan(spark, tmp_path, overlap):
    rng = random.Random(overlap)
    rows = [(i, rng.choice([None, "", "x", "abcdefghijk" * rng.randint(1, 6)])) for i in range(160)]
    files = [rows[i:i + 20] for i in range(0, 160, 20)]
    if overlap:
        files[1].append((65, "overlapping text"))
        files.append([(None, "no key")])
    path = str(tmp_path / "docs")
    write_files(spark, path, files)
    whole = samples.sample_windows(codes(read_corpus(spark, path).filter("doc_id IS NOT NULL")), 10, 7)
    for cap in (0, 1, 9, 40, 10_000):
        got = samples.capped_samples(spark, path, cap, codes, 4, 10, 7)
        want = samples.limit_samples(whole, cap, 4)
        pick = ["doc_id", "k", "start_idx", "i", "batch_id", "complete", "x"]
        assert sorted(map(str, got.select(pick).collect())) == sorted(map(str, want.select(pick).collect()))
    groups = samples.files_in_key_order(spark, path)
    assert len(groups) == (6 if overlap else 8)
    few = samples.files_for_samples(spark, path, 5, codes, 10)
    assert len(few) == 1
    assert samples.capped_samples(spark, path, 5, codes, 4, 10, 7).count() == 5


def test_the_plan_of_a_small_cap_reads_the_first_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    write_files(spark, path, [[(10 * f + i, "some text " * 3) for i in range(10)] for f in range(6)])
    first = samples.files_for_samples(spark, path, 12, codes, 10)
    read = read_corpus(spark, first)
    assert sorted(r.doc_id for r in read.collect()) == list(range(10))
    assert len(read.inputFiles()) == 1 and len(spark.read.parquet(path).inputFiles()) == 6


def test_round_pass_equals_separate_steps(spark, training_set, monkeypatch):
    """Losses and gradients of the one pass equal those of the separate operators, with one chunk of U and with several."""
    from glyphmill.operators import scoring
    per_sample, _, params = training_set
    embed, unembed = (params.filter(F.col("tensor") == t).select(F.col("row").alias("idx"), "vec") for t in ("embed", "unembed"))
    batch, val = per_sample.filter("doc_id < 5"), per_sample.filter("doc_id >= 5")
    pairs = batch.groupBy("x", "y").agg(F.sum("n").alias("n"))
    want = {(r.tensor, r.row): list(r.vec) for r in training.batch_gradients(pairs, params).collect()}
    losses = {r.doc_id: r.loss for r in scoring.losses_from_pairs(per_sample, embed, unembed, ["doc_id"]).collect()}
    for most in (scoring.MAX_CHUNK_DOUBLES, 8):
        monkeypatch.setattr(scoring, "MAX_CHUNK_DOUBLES", most)
        chunks = scoring.UnembedChunks(unembed)
        assert len(chunks.parts) == (1 if most > 8 else 3)
        found = training.round_pass(batch, val, params, chunks).cache()
        got = training.vector_ops.sum_vectors(found.filter("tensor IS NOT NULL"), ["tensor", "row"], "vec", "vec")
        got = {(r.tensor, r.row): list(r.vec) for r in got.collect()}
        close(got, want)
        mine, other = training.round_losses(found, batch, val)
        assert (mine.n, other.n) == (5, 4)
        assert abs(mine.max - max(losses[d] for d in range(5))) < 1e-9
        assert abs(other.avg - sum(losses[d] for d in range(5, 9)) / 4) < 1e-9


def test_update_does_not_shuffle_the_parameters(spark, training_set):
    from glyphmill.operators import vector_ops
    from glyphmill.session import drop_bucketed, save_bucketed
    keys = vector_ops.PARAM_KEYS
    params = training_set[2].select(*keys, "vec")
    p, p_name = save_bucketed(params.repartition(4, *keys), keys, 4)
    g, g_name = save_bucketed(params.filter("row < 3").repartition(4, *keys), keys, 4)
    new = vector_ops.apply_update(p, vector_ops.scale_vectors(g, 0.5).hint("merge"), 0.1)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = vector_ops.apply_update(params, vector_ops.scale_vectors(params.filter("row < 3"), 0.5), 0.1)
    close(rows_of(new), rows_of(want))
    for name in (p_name, g_name):
        folder = spark.table(name).inputFiles()[0].rpartition("/")[0]
        drop_bucketed(spark, name)
        assert not spark.catalog.tableExists(name)
        from glyphmill.sources.corpus import path_exists
        assert not path_exists(spark, folder)
