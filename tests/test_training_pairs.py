"""Training pairs by batch: looked up where batches follow the keys, joined where they do not."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import training
from glyphmill.session import save_scratch

WINDOW = "doc_id long, k int, xs array<int>, ys array<int>, ns array<int>"


def tables(spark, kind):
    rng = random.Random(3)
    windows = [(d, k, [d % 5, k], [1, 2], [1, 3]) for d in range(-7, 60, 2) for k in range(rng.choice([1, 1, 4, 30]))]
    ids = [(d, k, -(-i // 10), True) for i, (d, k, *_) in enumerate(windows)]
    ids = [r for r in ids if r[2] * 10 <= len(ids) - 1]
    if kind == "later":                     # of a run that goes on
        ids = [r for r in ids if r[2] >= 4]
    if kind == "mixed":
        ids = [(d, k, i % 7, True) for i, (d, k, *_) in enumerate(windows)]
    if kind == "repeated":
        windows.append((-5, 0, [4], [4], [9]))
        ids += [r for r in ids if r[:2] == (-5, 0)]
    if kind == "unknown":                   # a window that is in no batch
        del ids[12]
    if kind == "null":
        windows.append((None, 0, [4], [4], [9]))
    rng.shuffle(windows)
    return (save_scratch(spark.createDataFrame(windows, WINDOW).repartition(3), "windows"),
            spark.createDataFrame(ids, "doc_id long, k int, batch_id long, complete boolean"))


def rows_of(df):
    return sorted((r.batch_id, r.doc_id, r.k, tuple(sorted(zip(r.xs, r.ys, r.ns, strict=True)))) for r in df.collect())


@pytest.mark.parametrize("folders", [False, True])
@pytest.mark.parametrize("kind", ["plain", "later", "mixed", "repeated", "unknown", "null"])
def test_looked_up_as_joined(spark, monkeypatch, kind, folders):
    windows, ids = tables(spark, kind)
    monkeypatch.setattr(training, "PARTITION_SAMPLES", 40)
    spans = training._spans(windows, ids.select("doc_id", "k", "batch_id"))
    assert (spans is not None) == (kind in ("plain", "later", "null"))
    got = rows_of(training.write_training_pairs(windows, ids, folders))
    monkeypatch.setattr(training, "_spans", lambda *_: None)
    want = rows_of(training.write_training_pairs(windows, ids, folders))
    assert got == want and len(want) >= ids.count()


def test_windows_are_shuffled_once(spark, monkeypatch):
    plans = []
    real = training.save_scratch

    def save(df, name, folder_by=None):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name, folder_by)

    windows, ids = tables(spark, "plain")
    monkeypatch.setattr(training, "save_scratch", save)
    training.write_training_pairs(windows, ids, False)
    plan = dict(plans)["pairs"]
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1, plan


def test_rows_wait_for_no_python_function(spark):
    """Rows beside a Python function's arguments are queued, on disk at last: more than the tables themselves."""
    windows, ids = tables(spark, "plain")
    spans = training._spans(windows, ids.select("doc_id", "k", "batch_id"))[1]
    found = training._batch_of(spans, F.col("doc_id"), F.col("k"))
    assert "split" in windows.select(found)._jdf.queryExecution().analyzed().toString()
    plan = windows.select("doc_id", "k", found.alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "split" not in plan
    batch = {(r.doc_id, r.k): r.batch_id for r in ids.collect()}
    rows = spark.range(-9, 63).crossJoin(spark.range(-1, 32).withColumnRenamed("id", "k")).selectExpr("id AS doc_id", "k")
    got = {(r.doc_id, r.k): r.b for r in rows.select("doc_id", "k", found.alias("b")).collect()}
    assert {key: got[key] for key in batch} == batch
    assert all((b is None) == (key < spans[0][1] or key > spans[-1][2]) for key, b in got.items())
