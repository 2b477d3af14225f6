"""Gradient rounds of small batches: no exchange, and the same rows as with one."""

from pyspark.sql import functions as F

from glyphmill.operators import samples, scoring, training
from glyphmill.session import save_scratch


def test_small_round_has_no_exchange(spark):
    rows = [(d, 0, [d % 3, 1, 2], [1, 2, d % 3], [1, 2, 3]) for d in range(6)] + [(5, 0, [0], [1], [4])]
    packed = spark.createDataFrame(rows, "doc_id long, k int, xs array<long>, ys array<long>, ns array<long>")
    packed = save_scratch(packed.repartition(3), "packed")
    merged = samples.merged_pairs(packed, ["doc_id", "k"])
    one = merged.filter("doc_id = 5").first()
    assert merged.count() == 6 and sorted(zip(one.xs, one.ys, one.ns)) == [(0, 1, 4), (1, 2, 2), (2, 1, 1), (2, 2, 3)]
    params = save_scratch(training.init_params(spark, training.ModelShape(vocab_size=3, embed_dim=4, n_heads=2), 3), "params")
    chunks = scoring.UnembedChunks(params.filter("tensor = 'unembed'").select(F.col("row").alias("idx"), "vec"))
    assert training.param_buckets(spark, chunks) == 1
    found = {}
    for small in (False, True):
        batch = samples.exploded_pairs(training._fitted(packed, small))
        done = training.round_pass(batch, None, params, chunks, small)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) != small
        losses, _ = training.round_losses(save_scratch(done, "round"), batch, None, small)
        found[small] = (losses.n, round(losses.avg, 9), round(losses.max, 9))
    assert found[False] == found[True]
