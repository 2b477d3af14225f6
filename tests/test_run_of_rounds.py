"""Rounds of a small model in one task: the same as a round at a time, in jobs that do not grow with the rounds."""

import random
import uuid
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import scoring, training


def training_set(spark, n_rounds, seed=5):
    rng = random.Random(seed)
    pairs = [(d, 0, rng.randrange(6), rng.randrange(6), rng.randint(1, 3)) for d in range(2 * n_rounds - 1) for _ in range(4)]
    merged = spark.createDataFrame(pairs, "doc_id long, k int, x long, y long, n long").groupBy("doc_id", "k", "x", "y").agg(F.sum("n").alias("n"))
    ids = spark.createDataFrame([(d, 0, -(-d // 2), True) for d in range(2 * n_rounds - 1)], "doc_id long, k int, batch_id long, complete boolean")
    params = training.init_params(spark, training.ModelShape(vocab_size=6, embed_dim=4, n_heads=2), 3)
    val = merged.filter("doc_id < 3").select("doc_id", "x", "y", "n")
    return merged, ids, params, val


def result(out):
    params, metrics = out
    return ({(r.tensor, r.block, r.row): list(r.vec) for r in params.collect()},
            {r.batch_id: [r.avg_loss, r.min_loss, r.max_loss, r.n_samples, r.val_loss, r.grad_norm] for r in metrics.collect()})


def close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(x - y) < 1e-11 for k in a for x, y in zip(a[k], b[k], strict=True))


def jobs_of(spark, fn):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        return fn(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("default", "")


def test_runs_equal_single_rounds(spark, monkeypatch):
    merged, ids, params, val = training_set(spark, 5)
    cfg = training.TrainConfig(batch_size=2, lr=0.1)
    runs = result(training.train(merged, ids, params, cfg, val))
    monkeypatch.setattr(scoring, "MAX_CHUNK_DOUBLES", 2 * 2 * 6 * 4)      # two rounds a run
    short = result(training.train(merged, ids, params, cfg, val))
    most = merged.join(ids, ["doc_id", "k"]).groupBy("batch_id").count()
    monkeypatch.setattr(training, "ONE_TASK_PAIRS", most.filter("batch_id = 2").first()[1] - 1)  # some rounds in runs, some alone
    mixed = result(training.train(merged, ids, params, cfg, val.limit(3)))
    monkeypatch.setattr(training, "ONE_TASK_PAIRS", 0)
    single = result(training.train(merged, ids, params, cfg, val))
    for found in (runs, short):
        for a, b in zip(found, single, strict=True):
            close(a, b)
    close(mixed[0], single[0])


def test_jobs_do_not_grow_with_the_rounds(spark):
    counts = {}
    for n in (3, 12):
        *data, val = training_set(spark, n)
        (_, metrics), counts[n] = jobs_of(spark, lambda data=data, val=val: training.train(
            *data, training.TrainConfig(batch_size=2, lr=0.1), val))
        assert metrics.count() == n
    assert counts[12] <= counts[3] + 3, counts


def test_checkpoints_of_a_run(spark, tmp_path):
    merged, ids, params, val = training_set(spark, 6)
    cfg = training.TrainConfig(batch_size=2, lr=0.1, checkpoint_every=2, output_dir=str(tmp_path / "run"))
    want = result(training.train(merged, ids, params, cfg, val))
    assert sorted(p.name for p in Path(cfg.output_dir).glob("round=*")) == ["round=000001", "round=000003", "round=000005"]
    last = {(r.tensor, r.block, r.row): list(r.vec) for r in spark.read.parquet(f"{cfg.output_dir}/round=000005").collect()}
    close(last, want[0])
    assert training.last_commit(spark, cfg) == 5
    with pytest.raises(FileExistsError):
        training.train(merged, ids, params, cfg, val)


def test_an_entry_of_the_log_is_missing(spark, tmp_path):
    """A run that ended while its entries were moved to their place: training goes on before the gap."""
    merged, ids, params, val = training_set(spark, 6)
    cfg = training.TrainConfig(batch_size=2, lr=0.1, checkpoint_every=1, output_dir=str(tmp_path / "run"), resume=True)
    want = result(training.train(merged, ids, params, replace(cfg, output_dir=None), val))
    whole = replace(cfg, output_dir=str(tmp_path / "whole"))
    training.train(merged, ids, params, whole, val)
    log = spark.read.parquet(f"{whole.output_dir}/commits")
    log.filter("committed <> 3").write.partitionBy("committed").parquet(f"{cfg.output_dir}/commits")
    for i in (0, 1, 2, 4, 5):
        spark.read.parquet(f"{whole.output_dir}/round={i:06d}").write.parquet(f"{cfg.output_dir}/round={i:06d}")
    assert training.last_commit(spark, whole) == 5 and training.last_commit(spark, cfg) == 2
    for a, b in zip(result(training.train(merged, ids, params, cfg, val)), want, strict=True):
        close(a, b)
    assert training.last_commit(spark, cfg) == 5
