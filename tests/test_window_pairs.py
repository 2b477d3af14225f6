"""Pair counts and losses of windows in their own rows (no row a window and pair is shuffled)."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import samples, scoring


@pytest.fixture
def windows(spark):
    rng = random.Random(4)
    rows = []
    for d in range(12):
        seq = [rng.choice([3, 7, 9, 1_200_000]) for _ in range(rng.randrange(1, 9))]
        rows.append((d // 2, 0, seq[:-1], seq[1:]))                # a key may be on two rows
    return spark.createDataFrame(rows, "doc_id long, k int, x array<long>, y array<long>")


def test_counted_pairs_beyond_the_one_sort_range():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 30):
        row, x, y, n = np.sort(rng.integers(0, 4, 300)), rng.integers(0, 5, 300) + high, rng.integers(0, 5, 300), rng.integers(1, 9, 300)
        for m in (n, np.ones(300, np.int64)):
            want = Counter()
            for key in zip(row.tolist(), x.tolist(), y.tolist(), m.tolist(), strict=True):
                want[key[:3]] += key[3]
            got = samples.counted_pairs(x, y, m, row)
            assert sorted(want.items()) == [((r, a, b), c) for r, a, b, c in zip(*(v.tolist() for v in got), strict=True)]


def test_window_pairs_equal_pair_counts(windows):
    packed = samples.window_pairs(windows)
    assert packed.count() == windows.count()
    got = samples.exploded_pairs(packed).groupBy("doc_id", "k", "x", "y").agg(F.sum("n").alias("n"))
    assert sorted(got.collect()) == sorted(samples.pair_counts(windows, ["doc_id", "k"]).collect())
    assert sorted(samples.total_pairs(packed).collect()) == sorted(samples.pair_counts(windows).collect())
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ids_and_a_code_without_one(spark, windows):
    ids = spark.createDataFrame([(3, 0), (7, 1), (9, 2), (1_200_000, 3)], "code long, tok_idx int")
    got = samples.exploded_pairs(samples.window_pairs(windows, ids))
    assert got.agg(F.max(F.greatest("x", "y")), F.sum("n")).first() == (3, windows.select(F.sum(F.size("x"))).first()[0])
    with pytest.raises(Exception, match="without a model id"):
        samples.window_pairs(windows, ids.filter("code > 3")).collect()


@pytest.mark.parametrize("most", [scoring.MAX_TERMS, 0])
def test_losses_from_windows(spark, windows, most):
    packed = samples.window_pairs(windows)
    terms = samples.total_pairs(packed).select("x", "y", (F.col("x") * 0.5 + F.col("y")).alias("term"))
    want = scoring.losses_from_terms(samples.pair_counts(windows, ["doc_id", "k"]), terms, ["doc_id", "k"])
    got = scoring.losses_from_windows(packed, terms, ["doc_id", "k"], most)
    rows = {(r.doc_id, r.k): r.loss for r in got.collect() if r.loss}
    assert rows == pytest.approx({(r.doc_id, r.k): r.loss for r in want.collect()})
    if most:
        with pytest.raises(Exception, match="without a term"):
            scoring.losses_from_windows(packed, terms.filter("x = 3"), ["doc_id", "k"]).collect()
